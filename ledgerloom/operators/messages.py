"""The message log: claiming, dead-lettering, resetting, routing and admission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import dead_letter_reply_id
from ..schemas import EXIT_SEQUENCE
from .filters import due, in_shards, unguarded, unprocessed

DEAD_LETTER = "max retries exceeded"


@dataclass(frozen=True)
class Claim:
    """What a poll yields."""

    delivered: DataFrame
    dead_letters: DataFrame
    claimed: DataFrame


def eligible(messages: DataFrame, shards: DataFrame, as_of: Column, guard_seconds: float, locked: DataFrame | None = None) -> DataFrame:
    """Unprocessed, due and unguarded messages of the shards; those that another claimer has locked are skipped."""
    found = in_shards(messages.filter(unprocessed() & due(as_of) & unguarded(as_of, guard_seconds)), shards)
    return found if locked is None else found.join(locked.select("request_id").distinct(), "request_id", "left_anti")


def claim(
    messages: DataFrame,
    replies: DataFrame,
    shards: DataFrame,
    as_of: Column,
    limit: int = 1000,
    max_retries: int = 10,
    guard_seconds: float = 600,
    locked: DataFrame | None = None,
) -> Claim:
    """Claim the lowest request ids that are eligible, up to `limit` (0: all).

    Each claimed message has its retry count raised and its read time set.  With max_retries > 0, one whose old
    count exceeds it is dead-lettered: processed, with a failure exit unless it has one.  `delivered` holds the
    other messages as they were before the claim, `claimed` the new state of all of them.  The limit is a top-k
    over request ids that Spark takes with one small heap for each partition.
    """
    found = eligible(messages, shards, as_of, guard_seconds, locked)
    taken = found.orderBy("request_id").limit(limit) if limit > 0 else found
    dead = (F.lit(max_retries > 0) & (F.col("retry_count") > max_retries)).alias("dead")
    taken = taken.withColumn("_dead", dead)
    changed = {"retry_count": F.col("retry_count") + 1, "last_read": as_of, "processed": F.col("processed") | F.col("_dead")}
    claimed = taken.select(*(changed[c].alias(c) if c in changed else c for c in messages.columns))
    exits = replies.filter("is_exit").select("request_id")
    letters = taken.filter("_dead").select("request_id").join(exits, "request_id", "left_anti")
    letters = letters.select(
        dead_letter_reply_id(F.col("request_id")).alias("id"), "request_id", F.lit(EXIT_SEQUENCE).alias("sequence"), F.lit(DEAD_LETTER).alias("payload"), F.lit(True).alias("is_exit")
    )
    return Claim(taken.filter("not _dead").select(messages.columns), letters, claimed)


def after_claim(messages: DataFrame, claimed: DataFrame) -> DataFrame:
    """The whole message table after a claim."""
    return messages.join(claimed.select("request_id"), "request_id", "left_anti").unionByName(claimed)


def deliveries(first_retry_count: Column, max_retries: int) -> Column:
    """How often a message is delivered before it is dead-lettered; null when it never is."""
    if max_retries <= 0:
        return F.lit(None).cast("int")
    return F.greatest(F.lit(max_retries + 1) - first_retry_count, F.lit(0)).cast("int")


def reset_shards(messages: DataFrame, replies: DataFrame, shards: DataFrame) -> DataFrame:
    """Messages after their shards changed owner: unread and unprocessed again, unless they have an exit reply."""
    exits = replies.filter("is_exit").select("request_id").distinct().withColumn("_exit", F.lit(True))
    owned = shards.select("shard_group", "shard_id").distinct().withColumn("_moved", F.lit(True))
    met = messages.join(owned, ["shard_group", "shard_id"], "left").join(exits, "request_id", "left")
    hit = F.col("_moved").isNotNull() & F.col("_exit").isNull()
    changed = {"processed": F.lit(False), "retry_count": F.lit(0), "last_read": F.lit(None).cast(messages.schema["last_read"].dataType)}
    return met.select(*(F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c for c in messages.columns))


# --------------------------------------------------------------------------- routing
def route(rows: DataFrame, owned: DataFrame, assignment: DataFrame, me: str) -> DataFrame:
    """`rows` with columns owner and decision: local when we own the shard, remote at its owner, else unassigned.

    A shard that is assigned to us but not owned yet is 'self': the message waits until the lock is ours.
    """
    key = ["shard_group", "shard_id"]
    mine = owned.select(*key).distinct().withColumn("_mine", F.lit(True))
    met = rows.join(mine, key, "left").join(assignment.select(*key, F.col("runner").alias("owner")), key, "left")
    decision = F.when(F.col("_mine"), "local").when(F.col("owner") == me, "self").when(F.col("owner").isNotNull(), "remote").otherwise("unassigned")
    return met.select(*rows.columns, "owner", decision.alias("decision"))


def interrupt_route(rows: DataFrame, owned: DataFrame, assignment: DataFrame, me: str) -> DataFrame:
    """Interrupts by where they go: local, forward to the owner, or error."""
    routed = route(rows, owned, assignment, me)
    where = F.when(F.col("decision").isin("local", "self"), "local").when(F.col("decision") == "remote", "forward").otherwise("error")
    return routed.withColumn("decision", where)


def dispatch(rows: DataFrame, registered: DataFrame, as_of: Column, timeout_seconds: int, first_seen: str) -> DataFrame:
    """`rows` with column verdict: dispatch when the entity type is registered, else wait, and fail at the timeout."""
    known = registered.select("entity_type").distinct().withColumn("_known", F.lit(True))
    late = F.col(first_seen) <= as_of - F.make_dt_interval(secs=F.lit(timeout_seconds))
    verdict = F.when(F.col("_known"), "dispatch").when(late, "fail").otherwise("wait")
    return rows.join(known, "entity_type", "left").select(*rows.columns, verdict.alias("verdict"))


# --------------------------------------------------------------------------- admission
def admit(arrivals: DataFrame, capacity: int, address: list[str], order: list[str]) -> DataFrame:
    """`arrivals` with column verdict: duplicate, full, or accepted.

    A request id that came before is a duplicate.  Of the others, an address takes the first `capacity` (0: all)
    while none of them completes; a mailbox that is full accepts nothing more.
    """
    first = arrivals.groupBy("request_id").agg(F.min(F.struct(*order)).alias("_first"))
    seen = arrivals.join(first, "request_id").withColumn("_new", F.struct(*order) == F.col("_first"))
    place = F.sum(F.col("_new").cast("int")).over(Window.partitionBy(*address).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    verdict = F.when(~F.col("_new"), "duplicate").when(F.lit(capacity > 0) & (place > capacity), "full").otherwise("accepted")
    return seen.withColumn("verdict", verdict).select(*arrivals.columns, "verdict")


def resumption_batches(waiting: DataFrame, address: list[str], size: int = 1024) -> DataFrame:
    """`waiting` with column batch: request ids of an address in order, so many at a time."""
    w = Window.partitionBy(*address).orderBy("request_id")
    return waiting.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def exhausted_replies(waiting: DataFrame, attempts: str, limit: int, reason: str = "mailbox full") -> DataFrame:
    """Failure exits of requests whose resumption was tried `limit` times (0: without limit)."""
    gone = waiting.filter(F.lit(limit > 0) & (F.col(attempts) >= limit))
    return gone.select(dead_letter_reply_id(F.col("request_id")).alias("id"), "request_id", F.lit(EXIT_SEQUENCE).alias("sequence"), F.lit(reason).alias("payload"), F.lit(True).alias("is_exit"))


def poll_cycle(fetched: DataFrame, size: int) -> DataFrame:
    """What of a fetch fits the inbox: the lowest request ids."""
    return fetched.orderBy("request_id").limit(size)
