from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.functions.schedule import Schedule, field_values, next_after
from ledgerloom.operators import assignment as A
from ledgerloom.operators import filters as B
from ledgerloom.operators import keyed as K
from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import messages as M
from ledgerloom.operators import replies as R
from ledgerloom.schemas import EXIT_SEQUENCE, violations

MESSAGE = "request_id long, shard_group string, shard_id int, processed boolean, retry_count int, deliver_at timestamp_ntz, last_read timestamp_ntz"
REPLY = "id long, request_id long, sequence int, payload string, is_exit boolean"
NOW = datetime(2025, 1, 1, 12)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def shards(spark, *ids):
    return spark.createDataFrame([("default", i) for i in ids], "shard_group string, shard_id int")


def messages(spark, *rows):
    return spark.createDataFrame([(i, "default", s, p, n, d, r) for i, s, p, n, d, r in rows], MESSAGE)


def test_shard_and_due_filters(spark):
    m = messages(spark, (9000, 0, False, 0, None, None), (9001, 1, False, 0, None, None), (18000, 1, False, 0, datetime(2025, 1, 1, 13), None), (18002, 1, False, 0, datetime(2025, 1, 1, 11), None))
    none = spark.createDataFrame([], REPLY)
    got = M.claim(m, none, shards(spark, 1), now(), guard_seconds=0).delivered
    assert {r["request_id"] for r in got.collect()} == {9001, 18002}


def test_read_guard_is_strict(spark):
    at = lambda s: datetime(2025, 1, 1, 11, 59, s)
    m = messages(spark, (1, 0, False, 0, None, at(50)), (2, 0, False, 0, None, at(49)), (3, 0, False, 0, None, None))
    assert {r["request_id"] for r in m.filter(B.unguarded(now(), 10)).collect()} == {2, 3}


def test_dead_letter_on_the_fourth_poll(spark):
    m, replies, seen = messages(spark, (7, 0, False, 0, None, None)), spark.createDataFrame([], REPLY), []
    for _ in range(5):
        c = M.claim(m, replies, shards(spark, 0), now(), max_retries=2, guard_seconds=0)
        seen.append((c.delivered.count(), c.dead_letters.count()))
        replies = spark.createDataFrame(replies.unionByName(c.dead_letters).collect(), REPLY)
        m = spark.createDataFrame(M.after_claim(m, c.claimed).collect(), MESSAGE)
    assert seen == [(1, 0), (1, 0), (1, 0), (0, 1), (0, 0)]
    r = replies.first()
    assert (r["id"], r["sequence"], r["is_exit"]) == (-7, EXIT_SEQUENCE, True)


def test_claim_without_limit_and_with_locked_rows(spark):
    m = messages(spark, *((i, 0, False, 0, None, None) for i in range(20)))
    none = spark.createDataFrame([], REPLY)
    locked = spark.createDataFrame([(i,) for i in range(5)], "request_id long")
    assert M.claim(m, none, shards(spark, 0), now(), limit=0).delivered.count() == 20
    got = M.claim(m, none, shards(spark, 0), now(), limit=10, locked=locked).delivered
    assert sorted(r["request_id"] for r in got.collect()) == list(range(5, 15))
    assert M.claim(m, none, shards(spark), now()).delivered.count() == 0


def test_reply_order_and_constraints(spark):
    r = spark.createDataFrame([(3, 1, 2, "c", False), (1, 1, 0, "a", False), (2, 1, 1, "b", False), (9, 1, 0, "x", True)], REPLY)
    assert [x["payload"] for x in R.ordered(r).orderBy("position").collect()] == ["a", "b", "c", "x"]
    assert {x["check"]: x["n"] for x in violations(r, "replies").collect()} == {"exit_sequence": 1, "key": 1}


def test_stream_reassembly(spark):
    rows = [(1, 1, ["b"], 0), (1, 0, ["a", "A"], 1), (1, 0, ["late"], 2), (1, 3, ["old"], 3), (1, 3, ["d"], 4), (1, 2, [], 5), (1, 5, ["f"], 6)]
    got = R.reassemble(spark.createDataFrame(rows, "request_id long, sequence int, values array<string>, arrival int")).orderBy("position").collect()
    assert [(x["value"], x["phase"]) for x in got] == [("a", "stream"), ("A", "stream"), ("b", "stream"), ("d", "close"), ("f", "close")]


def runners(spark, *rows):
    return spark.createDataFrame([(h, 9000, w, True, k) for k, (h, w) in enumerate(rows)], "host string, port int, weight int, healthy boolean, position int")


def counts(df):
    return {r["runner"].split(":")[0]: r["n_shards"] for r in A.per_runner(df).collect()}


def test_rendezvous(spark):
    all_ = A.shard_table(spark, ["default"], 2048)
    three = A.rendezvous(all_, runners(spark, ("host1", 1), ("host2", 1), ("host3", 1)), "position")
    assert counts(three) == {"host1": 666, "host2": 683, "host3": 699}
    four = A.rendezvous(all_, runners(spark, ("host1", 1), ("host2", 1), ("host3", 1), ("host4", 1)), "position")
    change = A.moved(three, four).collect()
    assert len(change) == 479 and {r["runner_after"] for r in change} == {"host4:9000"}
    assert counts(A.rendezvous(all_, runners(spark, ("host1", 3), ("host2", 1)), "position")) == {"host1": 1522, "host2": 526}
    assert counts(A.rendezvous(all_, runners(spark, ("host1", 1), ("host2", 0)), "position")) == {"host1": 2048}


def test_ring_moves_only_what_it_must(spark):
    all_ = A.shard_table(spark, ["default"], 1024)
    before = A.ring(all_, runners(spark, ("host1", 1), ("host2", 1), ("host3", 1)))
    after = A.ring(all_, runners(spark, ("host1", 1), ("host2", 1)))
    assert before.count() == 1024 and set(counts(before)) == {"host1", "host2", "host3"}
    assert {r["runner_before"] for r in A.moved(before, after).collect()} == {"host3:9000"}


def test_ownership_difference(spark):
    desired = spark.createDataFrame([("default", 0, "host1:9000"), ("default", 1, "host1:9000"), ("default", 2, "host2:9000")], "shard_group string, shard_id int, runner string")
    got = A.difference(desired, shards(spark, 0, 3), "host1:9000").collect()
    assert {(r["shard_id"], r["change"]) for r in got} == {(1, "acquire"), (3, "release")}


def test_prefix_bounds():
    assert [B.prefix_upper_bound(p) for p in ("abc", "az", "", "result/")] == ["abd", "a{", None, "result0"]


def test_counter_flow(spark):
    flow = spark.createDataFrame([("c", 1, 5, False), ("c", 2, 3, False), ("c", 3, -2, False), ("c", 4, 0, True)], "e string, n int, d long, reset boolean")
    assert [r["value"] for r in K.running(flow, ["e"], ["n"], "d", resets=F.col("reset")).orderBy("n").collect()] == [5, 8, 6, 0]


def test_insert_ignore_and_upsert(spark):
    state = spark.createDataFrame([(1, "old", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (2, "first", 2), (2, "second", 3)], "k int, v string, n int")
    after, out = K.insert_ignore(state, new, ["k"], ["n"])
    assert {(r["k"], r["v"]) for r in after.collect()} == {(1, "old"), (2, "first")}
    assert [r["inserted"] for r in out.orderBy("n").collect()] == [False, True, False]
    assert {(r["k"], r["v"]) for r in K.upsert(state, new, ["k"], ["n"]).collect()} == {(1, "x"), (2, "second")}


def test_locks(spark):
    locks = spark.createDataFrame([("default", 1, "me"), ("default", 2, "you")], "shard_group string, shard_id int, owner string")
    after, got = K.acquire(locks, shards(spark, 1, 2, 3), F.lit("me"))
    assert {r["shard_id"]: r["acquired"] for r in got.collect()} == {1: True, 2: False, 3: True}
    assert K.release(after, None, F.lit("me")).count() == 1


def test_health_never_leaves_nobody(spark):
    r = spark.createDataFrame([("a", True), ("b", False), ("me", False)], "runner string, healthy boolean")
    dead = spark.createDataFrame([("a", False), ("b", False), ("me", False)], "runner string, alive boolean")
    assert {x["runner"]: x["healthy_after"] for x in L.update_health(r, dead, "me").collect()} == {"a": True, "b": False, "me": True}
    one = spark.createDataFrame([("a", False), ("b", True)], "runner string, alive boolean")
    assert {x["runner"]: x["healthy_after"] for x in L.update_health(r, one, "me").collect()} == {"a": False, "b": True, "me": False}


def test_cron(spark):
    assert field_values("mon-fri", 1, 7, {"mon": 2, "fri": 6}) == frozenset(range(2, 7))
    assert field_values("*/20", 0, 59, {}) == frozenset((0, 20, 40))
    refs = spark.createDataFrame([(datetime(2024, 2, 28, 23, 59, 59),), (datetime(2024, 2, 29, 12, 0, 0),), (datetime(2024, 2, 29, 12, 0, 30),)], "t timestamp_ntz")
    got = next_after(refs, Schedule.parse("0,30 0 12 29 feb * *"), "t", 3000).orderBy("t").collect()
    assert [r["next_at"] for r in got] == [datetime(2024, 2, 29, 12), datetime(2024, 2, 29, 12, 0, 30), datetime(2028, 2, 29, 12)]


def test_empty_inputs(spark):
    none, replies = messages(spark), spark.createDataFrame([], REPLY)
    c = M.claim(none, replies, shards(spark, 0), now())
    assert (c.delivered.count(), c.dead_letters.count(), c.claimed.count()) == (0, 0, 0)
    assert R.ordered(replies).count() == 0
