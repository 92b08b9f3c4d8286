"""Keyed state: inserts that ignore or replace, additive updates, deletes, expiry, locks and buffers.

State is a DataFrame with unique keys.  Every operator returns the state after a batch of arrivals; `order` names
the columns that say which arrival came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a hash aggregate (combined before the shuffle), not a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *(F.col("_r")[c].alias(c) for c in rest)).select(rows.columns)


def last_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *(F.col("_r")[c].alias(c) for c in rest)).select(rows.columns)


def insert_ignore(state: DataFrame, arrived: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state after, arrivals with column `inserted`): the first writer of a key wins, later ones change nothing."""
    new = first_of(arrived, key, order).join(state.select(*key), key, "left_anti")
    after = state.unionByName(new.select(state.columns))
    first = arrived.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    stored = state.select(*key).distinct().withColumn("_stored", F.lit(True))
    outcome = arrived.join(first, key).join(stored, key, "left")
    outcome = outcome.withColumn("inserted", F.col("_stored").isNull() & (F.struct(*order) == F.col("_first")))
    return after, outcome.select(*arrived.columns, "inserted")


def existing_exit(duplicates: DataFrame, replies: DataFrame) -> DataFrame:
    """`duplicates` with the exit reply of their request, null where there is none yet."""
    exits = replies.filter("is_exit").select("request_id", F.col("id").alias("exit_id"), F.col("payload").alias("exit_payload"))
    return duplicates.join(exits, "request_id", "left")


def upsert(state: DataFrame, arrived: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The state after arrivals, of which the last for a key replaces what was there."""
    new = last_of(arrived, key, order)
    return state.join(new.select(*key), key, "left_anti").unionByName(new.select(state.columns))


def add(state: DataFrame, deltas: DataFrame, key: list[str], value: str, delta: str) -> DataFrame:
    """The state after adding all deltas; a missing key starts at 0."""
    both = state.select(*key, F.col(value).alias("_v")).unionByName(deltas.select(*key, F.col(delta).alias("_v")))
    return both.groupBy(*key).agg(F.sum("_v").alias(value))


def running(deltas: DataFrame, key: list[str], order: list[str], delta: str, name: str = "value", resets: Column | None = None) -> DataFrame:
    """What each additive update returns: the sum so far, since the last reset if there are resets."""
    w = Window.partitionBy(*key).orderBy(*order)
    if resets is None:
        return deltas.withColumn(name, F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    epoch = deltas.withColumn("_e", F.sum(F.when(resets, 1).otherwise(0)).over(w))
    own = Window.partitionBy(*key, "_e").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return epoch.withColumn(name, F.sum(F.when(resets, 0).otherwise(F.col(delta))).over(own)).drop("_e")


def append_values(rows: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The array that appending each row's value in order leaves for each key."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value")))), lambda s: s["_value"]).alias(name))


def update_where(state: DataFrame, condition: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(state after, one row with the number of changed rows)."""
    hit = F.coalesce(condition, F.lit(False))
    after = state.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else c for c in state.columns))
    return after, state.agg(F.count_if(hit).alias("changed"))


def delete(state: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state after, `keys` with column `existed`)."""
    gone = keys.select(*key).distinct()
    there = state.select(*key).distinct().withColumn("existed", F.lit(True))
    return state.join(gone, key, "left_anti"), keys.join(there, key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def expire(state: DataFrame, at: str, cutoff: Column, when: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(state after, one row with the number of rows gone): rows whose `at` is strictly before the cutoff go."""
    old = F.col(at).isNotNull() & (F.col(at) < cutoff)
    old = F.coalesce(old if when is None else old & when, F.lit(False))
    return state.filter(~old), state.agg(F.count_if(old).alias("deleted"))


def mark_completed(journal: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """`journal` with completed_at set on the given keys; keys that are not there change nothing."""
    hit = keys.select("key").distinct().withColumn("_hit", F.lit(True))
    marked = journal.join(hit, "key", "left").withColumn("completed_at", F.when(F.col("_hit"), at).otherwise(F.col("completed_at")))
    return marked.select(journal.columns)


def commit_buffers(state: DataFrame, writes: DataFrame, outcomes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """State after transactions that buffer writes (tx, key..., value, op): commits apply, rollbacks leave nothing.

    In a transaction the last operation on a key wins; transactions apply by their commit order (outcomes.seq).
    An operation is 'save' or 'delete'.
    """
    done = writes.join(outcomes.filter("committed").select("tx", "seq"), "tx")
    last = last_of(done, key, ["seq", *order])
    return state.join(last.select(*key), key, "left_anti").unionByName(last.filter("op = 'save'").select(state.columns))


# --------------------------------------------------------------------------- shard locks
def acquire(locks: DataFrame, wanted: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(locks after, wanted with column `acquired`): a lock is taken when it is free or already ours."""
    key = ["shard_group", "shard_id"]
    met = wanted.join(locks, key, "left").withColumn("acquired", F.col("owner").isNull() | (F.col("owner") == owner))
    new = met.filter("acquired and owner is null").select(*key, owner.alias("owner")).distinct()
    return locks.unionByName(new), met.select(*wanted.columns, "acquired")


def classify_refresh(locks: DataFrame, held: DataFrame, owner: Column, failed: Column | None = None) -> DataFrame:
    """`held` with column outcome: refreshed while the lock is ours, lost when it is not, failed when the call failed."""
    met = held.join(locks, ["shard_group", "shard_id"], "left")
    outcome = F.when(F.col("owner") == owner, "refreshed").otherwise("lost")
    if failed is not None:
        outcome = F.when(failed, "failed").otherwise(outcome)
    return met.select(*held.columns, outcome.alias("outcome"))


def release(locks: DataFrame, shards: DataFrame | None, owner: Column) -> DataFrame:
    """Locks after releasing those of `shards` (all of the owner's with None) that the owner holds."""
    if shards is None:
        return locks.filter(F.col("owner") != owner)
    mine = locks.filter(F.col("owner") == owner).join(shards.select("shard_group", "shard_id").distinct(), ["shard_group", "shard_id"], "left_semi")
    return locks.join(mine.select("shard_group", "shard_id"), ["shard_group", "shard_id"], "left_anti")
