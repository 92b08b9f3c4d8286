"""Shards to runners: weighted rendezvous hashing, a hash ring, differences and rebalancing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import encoded, hash64_numpy
from .filters import assignable

ADDRESS = "concat(host, ':', port)"


def shard_table(spark: SparkSession, groups: list[str], per_group: int) -> DataFrame:
    """(shard_group, shard_id) of every shard."""
    ids = spark.range(per_group).select(F.col("id").cast("int").alias("shard_id"))
    return ids.select(F.explode(F.array(*map(F.lit, groups))).alias("shard_group"), "shard_id")


def slots(runners: DataFrame, position: str | None = None) -> DataFrame:
    """(runner, position, slot): one row for each unit of weight of each runner that may hold shards.

    `position` names the column with the runners' input order; without it they are in order of address.
    """
    able = assignable(runners).withColumn("runner", F.expr(ADDRESS))
    place = F.col(position).cast("long") if position else F.col("runner")
    return able.select("runner", place.alias("position"), F.explode(F.sequence(F.lit(0), F.col("weight") - 1)).alias("slot"))


#: A task's best slots by shard are handed on when they are more than this.
HELD = 50_000


def best_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The highest (score, position) of each shard among the pairs of a task; a score is the hash of `key`."""
    best = None
    for pairs in batches:
        pairs["score"] = (hash64_numpy(encoded(pairs.pop("key"))) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the hashes' order
        met = pairs if best is None else pd.concat([best, pairs])
        best = met.sort_values(["score", "position"], na_position="first").drop_duplicates(["shard_group", "shard_id"], keep="last")
        if len(best) > HELD:
            yield best
            best = None
    if best is not None:
        yield best


def rendezvous(shards: DataFrame, runners: DataFrame, position: str | None = None) -> DataFrame:
    """(shard_group, shard_id, runner): each shard goes to the runner whose best slot scores highest.

    A score hashes shard, address and slot; on equal scores the last runner in input order wins.  Every shard
    meets every slot, as the definition asks.  Slots are dealt over all tasks, however few files hold the runners;
    a task keeps the best slot of each shard as its pairs stream by, so pairs are neither sorted nor shuffled.
    """
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = slots(runners, position).repartition(n, "runner", "slot").crossJoin(shards)
    key = F.concat_ws("\0", F.concat_ws(":", "shard_group", "shard_id"), "runner", F.col("slot").cast("string"))
    met = pairs.select("shard_group", "shard_id", "runner", "position", key.alias("key"))
    scored = met.drop("key").withColumn("score", F.lit(None).cast("long"))
    best = met.mapInPandas(best_slots, scored.schema)
    return best.groupBy("shard_group", "shard_id").agg(F.max_by("runner", F.struct("score", "position")).alias("runner"))


def ring(shards: DataFrame, runners: DataFrame, per_weight: int = 150) -> DataFrame:
    """(shard_group, shard_id, runner) by a consistent-hash ring with `per_weight` virtual nodes for each unit of weight.

    A shard goes to the next virtual node at or after its hash, around the end to the first.  Nodes and shards
    are merged in one sorted pass over the ring, which is cut into arcs so that no task holds all of it.  Positions
    are Spark's xxhash64, so they agree with themselves and not with other ring libraries.
    """
    node = F.concat_ws("-", "runner", "slot", "v")
    nodes = slots(runners).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(per_weight - 1)))).select(F.xxhash64(node).alias("h"), "runner")
    nodes = nodes.groupBy("h").agg(F.min("runner").alias("runner"))
    keyed = shards.withColumn("h", F.xxhash64(F.concat_ws(":", "shard_group", "shard_id")))
    arc = F.shiftright(F.col("h"), 56)
    # the first node of every arc answers for shards that have no later node in their own
    firsts = nodes.groupBy(arc.alias("arc")).agg(F.min(F.struct("h", "runner")).alias("f"))
    following = firsts.agg(F.sort_array(F.collect_list(F.struct("arc", F.col("f.runner").alias("runner")))).alias("all"))  # 256 arcs at most
    both = nodes.select(arc.alias("arc"), "h", "runner", F.lit(None).cast("string").alias("shard_group"), F.lit(None).cast("int").alias("shard_id")).unionByName(
        keyed.select(arc.alias("arc"), "h", F.lit(None).cast("string").alias("runner"), "shard_group", "shard_id")
    )
    w = Window.partitionBy("arc").orderBy(F.col("h").desc(), F.col("runner").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("next", F.last("runner", ignorenulls=True).over(w)).filter("shard_id is not null").crossJoin(F.broadcast(following))
    later = F.try_element_at(F.filter("all", lambda x: x["arc"] > F.col("arc")), F.lit(1))["runner"]
    return met.select("shard_group", "shard_id", F.coalesce("next", later, F.element_at("all", 1)["runner"]).alias("runner"))


def assign(shards: DataFrame, runners: DataFrame, strategy: str = "rendezvous", **options) -> DataFrame:
    """By the named strategy."""
    return {"rendezvous": rendezvous, "parallel": rendezvous, "ring": ring}[strategy](shards, runners, **options)


def difference(desired: DataFrame, owned: DataFrame, me: str) -> DataFrame:
    """(shard_group, shard_id, change): what to acquire and what to release."""
    key = ["shard_group", "shard_id"]
    mine = desired.filter(F.col("runner") == me).select(*key).withColumn("_want", F.lit(True))
    held = owned.select(*key).distinct().withColumn("_have", F.lit(True))
    change = F.when(F.col("_have").isNull(), "acquire").when(F.col("_want").isNull(), "release")
    return mine.join(held, key, "full").select(*key, change.alias("change")).filter("change is not null")


def to_refresh(owned: DataFrame, releasing: DataFrame) -> DataFrame:
    """Shards whose locks are kept alive: owned ones and those being released."""
    key = ["shard_group", "shard_id"]
    return owned.select(*key).unionByName(releasing.select(*key)).distinct()


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(shard_group, shard_id, runner_before, runner_after) of shards that changed hands."""
    key = ["shard_group", "shard_id"]
    a, b = before.select(*key, F.col("runner").alias("runner_before")), after.select(*key, F.col("runner").alias("runner_after"))
    return a.join(b, key, "full").filter(~F.col("runner_before").eqNullSafe(F.col("runner_after")))


def per_runner(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("runner").agg(F.count("*").alias("n_shards"))


def per_shard(keys: DataFrame, shards: int) -> DataFrame:
    """Keys of each shard, and whether they are at most twice the expected number."""
    total = keys.agg(F.count("*").alias("_t"))
    return keys.groupBy("shard_id").agg(F.count("*").alias("n_keys")).crossJoin(total).select("shard_id", "n_keys", (F.col("n_keys") <= 2 * F.col("_t") / shards).alias("balanced"))
