import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import ids as I

M = (1 << 64) - 1
TEXTS = ["", "a", "hello", "entity-1", "é\0ü", "x" * 300, "日本語", "\x01\x7f"]


def djb2(data, seed=5381, bits=64):
    for b in data:
        seed = (seed * 33 + b) % (1 << bits)
    return seed


def mixed(data):
    h = (H.PRIME5 + len(data)) & M
    for b in data:
        h ^= (b * H.PRIME5) & M
        h = ((h << 11 | h >> 53) & M) * H.PRIME1 & M
    h = (h ^ h >> 33) * H.PRIME2 & M
    h = (h ^ h >> 29) * H.PRIME3 & M
    return h ^ h >> 32


def test_known_values():
    assert djb2(b"hello", bits=32) == 261238937
    assert mixed(b"hello") == 6448123193071645687


def test_columns_match_plain_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", H.djb2(F.col("t")).alias("a"), H.as_hex(H.djb2_64(F.col("t"))).alias("b"), H.as_hex(H.hash64(F.col("t"))).alias("c"), H.digest_hex(F.col("t")).alias("d"), H.hash64_fast(F.col("t")).alias("e")).collect()
    for r in got:
        raw = r["t"].encode()
        assert r["a"] == djb2(raw, bits=32)
        assert r["b"] == f"{djb2(raw):016x}"
        assert r["c"] == f"{mixed(raw):016x}"
        assert r["d"] == f"{mixed(raw):016x}{djb2(raw, H.SECOND_SEED):016x}"
        assert (r["e"] & M) ^ (1 << 63) == mixed(raw)


@given(st.lists(st.binary(max_size=40), max_size=20))
def test_vector_form(values):
    assert H.hash64_numpy(values).tolist() == [mixed(v) for v in values]


def test_request_and_reply_ids(spark):
    df = spark.createDataFrame([("T", "e", "tag", b"\x00\x05", 12345678901, 7)], "a string, b string, c string, k binary, r long, s int")
    r = df.select(H.persisted_request_id(F.col("a"), F.col("b"), F.col("c"), F.col("k")).alias("p"), H.fallback_reply_id(F.col("r"), F.col("s")).alias("f")).first()
    assert r["p"] == djb2(b"T\0e\0tag\0\x00\x05") & (M >> 1)
    assert r["f"] == djb2((12345678901).to_bytes(8, "big") + (7).to_bytes(4, "big")) & (M >> 1)


def test_shards(spark):
    df = spark.range(10_000).select(F.concat(F.lit("entity-"), F.col("id").cast("string")).alias("e"))
    counts = df.select(I.shard_of(F.col("e"), 300).alias("s")).groupBy("s").count().collect()
    assert max(r["count"] for r in counts) <= 2 * 10_000 / 300
    assert df.filter("e = 'entity-1'").select(I.shard_of(F.col("e"), 300).alias("s")).first()["s"] == 60
    with pytest.raises(ValueError):
        I.shard_of(F.col("e"), 0)


def test_snowflakes(spark):
    r = spark.sql("select 123456789012345678L as id").select(I.snowflake_parts(F.col("id")).alias("p")).first()["p"]
    assert (r["timestamp_ms"], r["machine_id"], r["sequence"]) == (1765123992216, 783, 846)
    wrap = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1025, 2048, -1)], "n long").select(I.wrap_machine_id(F.col("n")).alias("w")).collect()
    assert [x["w"] for x in wrap] == [0, 1023, 0, 1, 0, 1023]


def test_a_full_millisecond_spills_into_the_next(spark):
    df = spark.range(5000).select("id", F.lit(3).alias("m"), (F.lit(I.EPOCH_MS) + F.when(F.col("id") < 4500, 10).otherwise(11)).alias("ms")).withColumnRenamed("id", "n")
    ids = [r["id"] for r in I.generate(df, "m", "ms", ["n"]).select("id").collect()]
    assert len(set(ids)) == 5000
    assert {(x >> 22) for x in ids} == {10, 11} and all((x >> 12) & 1023 == 3 for x in ids)


def test_snowflakes_of_full_milliseconds_across_hours(spark):
    """Against a generator that waits for the next free slot, one request at a time."""
    rng = random.Random(1)
    rows = [(k, rng.randrange(3), I.EPOCH_MS + rng.choice([0, 1, I.HOUR_MS - 1, I.HOUR_MS, I.HOUR_MS + 1, 2 * I.HOUR_MS])) for k in range(30_000)]
    got = {r["k"]: r["id"] for r in I.generate(spark.createDataFrame(rows, "k long, m int, ms long"), "m", "ms", ["k"]).collect()}
    free, want = [0, 0, 0], {}
    for k, m, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        slot = max(free[m], (ms - I.EPOCH_MS) * 4096)
        free[m] = slot + 1
        want[k] = (slot // 4096 << 22) | (m << 12) | slot % 4096
    assert got == want


def test_clocks_that_step_back(spark):
    rows = [(0, 100_000), (1, 99_000), (2, 90_000), (3, 100_500), (4, 95_500), (5, 95_499)]
    got = I.with_drift(spark.createDataFrame([(1, *r) for r in rows], "m int, n int, ms long"), "m", "ms", ["n"]).orderBy("n").collect()
    assert [(r["used_ms"], r["outcome"]) for r in got] == [(100_000, "ok"), (100_000, "wait"), (None, "error"), (100_500, "ok"), (100_500, "wait"), (None, "error")]


def test_bulk_hashes_are_the_expressions(spark):
    rng = random.Random(2)
    texts = ["", "é", None, "x" * 3000, *("".join(rng.choice("abcé\0ÿ漢") for _ in range(rng.randrange(40))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", H.djb2_fast(F.col("t")).alias("a"), H.hash64_hex(F.col("t")).alias("b"), H.digest_hex(F.col("t")).alias("c")).collect():
        if r["t"] is None:
            assert r["a"] is None and r["b"] is None and r["c"] is None
        else:
            raw = r["t"].encode()
            assert r["a"] == djb2(raw) & 0xFFFFFFFF and r["b"] == f"{mixed(raw):016x}" and r["c"][:16] == r["b"]
