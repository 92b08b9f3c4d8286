"""Rendezvous assignment of many runners: what tasks do with the pairs, read off plans and off the function they run."""

import pandas as pd
import pytest
from test_hashing import M, mixed

from ledgerloom.operators import assignment as A
from ledgerloom.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["C6_shards_by_slots", "E6_rendezvous", "E7_rendezvous_parallel", "E8_strategy", "F8_argmax"])
def test_pairs_are_dealt_out_and_not_sorted(spark, sf, name):
    """The runners' one file is one partition; its slots meet the shards in many, and only the best are sorted."""
    below = plan(QUERIES[name](spark, sf)).split("MapInPandas", 1)[1].split("Union", 1)[0]
    pairs = below[: below.index("supplier.parquet")]
    assert "Sort" not in pairs and "Exchange hashpartitioning(runner" in pairs


def pairs(*rows):
    return pd.DataFrame(rows, columns=["shard_group", "shard_id", "runner", "position", "key"])


def test_best_slots_across_batches(monkeypatch):
    batches = [
        pairs(("g", 0, "a", 5, "x"), ("g", 1, "a", 5, "hello"), ("g", 0, "b", 9, "x")),  # equal scores: the later position
        pairs(("g", 0, "c", 7, "x"), ("h", 0, "c", 7, "z"), ("g", 1, "c", 7, "y")),
    ]
    high = max(("hello", "a"), ("y", "c"), key=lambda k: mixed(k[0].encode()))
    want = {("g", 0): "b", ("g", 1): high[1], ("h", 0): "c"}
    got = pd.concat(A.best_slots(iter([b.copy() for b in batches])))
    assert len(got) == 3 and {(r.shard_group, r.shard_id): r.runner for r in got.itertuples()} == want
    assert [(s & M) ^ (1 << 63) for s in got[got.shard_group == "h"]["score"].tolist()] == [mixed(b"z")]
    monkeypatch.setattr(A, "HELD", 1)  # more shards than a task may hold: handed on batch by batch
    assert sorted(map(len, A.best_slots(iter([b.copy() for b in batches])))) == [2, 3]
    assert list(A.best_slots(iter([]))) == []


def test_equal_scores_go_to_the_last_runner_in_input_order(spark):
    """Two entries of one address tie at every slot; addresses stand for the order where no position is given."""
    twice = spark.createDataFrame([("r", 1, 1, True, 1), ("r", 1, 1, True, 2), ("q", 1, 2, False, 3)], "host string, port int, weight int, healthy boolean, position int")
    for position in ("position", None):
        assert {r["runner"] for r in A.rendezvous(A.shard_table(spark, ["a", "b"], 40), twice, position).collect()} == {"r:1"}
    assert A.rendezvous(A.shard_table(spark, ["a"], 3), twice.filter("not healthy"), "position").count() == 0
