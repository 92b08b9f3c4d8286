"""Queries over whole tables against plain Python."""

import pytest
from test_hashing import M, djb2, mixed

from ledgerloom.queries import QUERIES
from ledgerloom.sources import views as V

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def able(spark):
    return [r for r in V.runners(spark, SF).collect() if r["healthy"] and r["weight"] > 0]


@pytest.mark.parametrize("name", ["C6_shards_by_slots", "E6_rendezvous", "E7_rendezvous_parallel", "F8_argmax"])
def test_all_shards_meet_all_runners(spark, able, name):
    if not hasattr(test_all_shards_meet_all_runners, "want"):
        score = lambda s, r: max(mixed(f"default:{s}\0{r['host']}:9000\0{w}".encode()) for w in range(r["weight"]))
        test_all_shards_meet_all_runners.want = {s: max(able, key=lambda r: (score(s, r), r["position"]))["host"] + ":9000" for s in range(V.SHARDS)}
    assert {r["shard_id"]: r["runner"] for r in QUERIES[name](spark, SF).collect()} == test_all_shards_meet_all_runners.want


def test_the_ring_holds_all_runners(spark, able):
    got = {r["runner"] for r in QUERIES["C12_ring"](spark, SF).collect()}
    assert got & {r["host"] + ":9000" for r in able if r["position"] > 12}


def test_all_line_items_have_a_fallback_reply_id(spark):
    rows = {tuple(r) for r in V.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber").collect()}
    want = {(k, n, djb2(k.to_bytes(8, "big") + n.to_bytes(4, "big")) & (M >> 1)) for k, n in rows}
    got = [(r["request_id"], r["sequence"], r["id"]) for r in QUERIES["S6_fallback_reply_id"](spark, SF).collect()]
    assert max(rows)[0] >= 2000 and len(got) == len(rows) and set(got) == want
