from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import replies as R
from ledgerloom.streaming import messages as S


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return df.sparkSession.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def test_reassembly_over_batches(spark, tmp_path):
    schema = "request_id long, sequence int, values array<string>, arrival int, close boolean"
    batches = [[(1, 1, ["b"], 0, False), (2, 0, ["x"], 1, False)], [(1, 0, ["a"], 2, False), (1, 3, ["old"], 3, False)], [(1, 1, ["late"], 4, False), (1, 3, ["d"], 5, False)], [(1, 0, [], 9, True), (2, 0, [], 9, True)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = S.table_stream(spark, str(tmp_path / "in" / "*"), schema, 1)
    got = {(r["request_id"], r["position"], r["value"]) for r in run(S.reassemble(stream), "reassembled")}
    batch = R.reassemble(spark.createDataFrame([r[:4] for b in batches for r in b], "request_id long, sequence int, values array<string>, arrival int"))
    assert got == {(r["request_id"], r["position"], r["value"]) for r in batch.collect()}


def test_detachments_match_the_batch_form(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    states = "HHUUHHHUHHHHHUUUHHHH"
    rows = [(r, t0 + timedelta(seconds=10 * k + r), c == "H") for r in (0, 1) for k, c in enumerate(states)]
    schema = "runner long, ts timestamp_ntz, healthy boolean"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "h"))
    got = {(r["runner"], r["ts"], r["transition"]) for r in run(S.detachments(S.table_stream(spark, str(tmp_path / "h"), schema), 20_000, 2), "detached")}
    want = {(r["runner"], r["ts"], r["transition"]) for r in L.detachments(df, ["runner"], "ts", F.col("healthy"), 20_000, 2).collect()}
    assert got == want and len(want) == 8


def test_polls_and_snapshots(spark, tmp_path):
    message = "request_id long, shard_group string, shard_id int, processed boolean, retry_count int, deliver_at timestamp_ntz, last_read timestamp_ntz"
    m = spark.createDataFrame([(k, "default", 0, False, 0, None, None) for k in range(5)], message)
    replies = spark.createDataFrame([], "id long, request_id long, sequence int, payload string, is_exit boolean")
    shards = spark.createDataFrame([("default", 0)], "shard_group string, shard_id int")
    spark.createDataFrame([(datetime(2024, 1, 1),)], "as_of timestamp_ntz").write.parquet(str(tmp_path / "t"))
    seen = []
    q = S.polls(S.table_stream(spark, str(tmp_path / "t"), "as_of timestamp_ntz"), lambda: (m, replies, shards), lambda c, n: seen.append((n, c.delivered.count())), str(tmp_path / "c1"), limit=3)
    q.awaitTermination(60)
    assert seen == [(0, 3)]
    schema = "host string, port int, weight int, healthy boolean, seq int"
    spark.createDataFrame([("a", 1, 1, True, 0), ("a", 1, 2, True, 1), ("b", 1, 1, False, 2)], schema).write.parquet(str(tmp_path / "r"))
    snaps = []
    q = S.runner_snapshots(S.table_stream(spark, str(tmp_path / "r"), schema), lambda df, n: snaps.append({(r["host"], r["weight"]) for r in df.collect()}), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert snaps[-1] == {("a", 2), ("b", 1)}


def test_first_writers(spark, tmp_path):
    schema = "k int, v string, at timestamp"
    spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))], schema).coalesce(1).write.parquet(str(tmp_path / "i"))
    got = run(S.first_writers(S.table_stream(spark, str(tmp_path / "i"), schema), ["k"], "at", "1 hour"), "firsts")
    assert sorted(r["k"] for r in got) == [1, 2]
