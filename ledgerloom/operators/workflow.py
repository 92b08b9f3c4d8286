"""Durable workflows: journal replay, timers, deferred values, retries, execution ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_hex, journal_key
from ..functions.schedule import activity_backoff
from .keyed import first_of, upsert

#: Fixed value: the deferred name that an interrupt resolves.
INTERRUPT = "__interrupt"


def replay(calls: DataFrame, journal: DataFrame) -> DataFrame:
    """Activity calls (name, key, entity_type, entity_id, ...) with their journal key and cached value.

    A call whose key is in the journal is answered from it; the others run.
    """
    keyed = calls.withColumn("journal_key", journal_key(F.col("name"), F.col("key"), F.col("entity_type"), F.col("entity_id")))
    held = journal.select(F.col("key").alias("journal_key"), F.col("value").alias("cached_value"))
    return keyed.join(held, "journal_key", "left").withColumn("cached", F.col("cached_value").isNotNull())


def journaled(calls: DataFrame, results: DataFrame, journal: DataFrame, order: list[str]) -> DataFrame:
    """The journal after running the calls that missed: successes are saved, errors are not."""
    missed = replay(calls, journal).filter("not cached").select(F.col("journal_key").alias("key"), "call_id")
    saved = missed.join(results.filter("ok"), "call_id").select("key", "value", *order)
    return upsert(journal.select("key", "value"), saved, ["key"], order)


def sleep(timers: DataFrame, requested: DataFrame, as_of: Column, order: list[str]) -> DataFrame:
    """Timers after sleep requests (workflow_name, execution_id, timer_name, fire_at): a timer that exists keeps its time.

    `fired` says whether the sleeper goes on.
    """
    key = ["workflow_name", "execution_id", "timer_name"]
    new = first_of(requested, key, order).join(timers.select(*key), key, "left_anti")
    both = timers.select(*key, "fire_at", "fired").unionByName(new.select(*key, "fire_at", F.lit(False).alias("fired")))
    return both.withColumn("fired", F.col("fired") | (F.col("fire_at") <= as_of))


def resolve(deferred: DataFrame, resolved: DataFrame, order: list[str]) -> DataFrame:
    """Deferred values after resolutions; the last one counts."""
    return upsert(deferred, resolved, ["workflow_name", "execution_id", "deferred_name"], order)


def await_deferred(waits: DataFrame, deferred: DataFrame) -> DataFrame:
    """`waits` with value and state: pending until resolved; resolved without a value is an error."""
    key = ["workflow_name", "execution_id", "deferred_name"]
    met = waits.join(deferred.filter("resolved").select(*key, "value", F.lit(True).alias("_done")), key, "left")
    state = F.when(F.col("_done").isNull(), "pending").when(F.col("value").isNull(), "error").otherwise("resolved")
    return met.select(*waits.columns, "value", state.alias("state"))


def interrupted(deferred: DataFrame) -> DataFrame:
    """Executions that were interrupted: their reserved deferred is resolved."""
    return deferred.filter((F.col("deferred_name") == INTERRUPT) & F.col("resolved")).select("workflow_name", "execution_id").distinct()


def attempts(calls: DataFrame, outcomes: DataFrame, retries: int, strategy: str = "exponential", base_secs: int = 1) -> DataFrame:
    """Retry loop of each call: (call_id, succeeded, attempts, waited_secs, error).

    `outcomes` (call_id, attempt, ok, error) says how attempt 0, 1, ... would end; an attempt without an outcome
    fails.  The loop ends at the first success or after 1 + retries attempts; the last error surfaces.
    """
    tried = calls.select("call_id", F.explode(F.sequence(F.lit(0), F.lit(retries))).alias("attempt")).join(outcomes, ["call_id", "attempt"], "left")
    best = tried.groupBy("call_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("_won"), F.max_by("error", "attempt").alias("_last"))
    ended = F.coalesce("_won", F.lit(retries))
    waits = F.when(ended > 0, F.transform(F.sequence(F.lit(0), F.greatest(ended - 1, F.lit(0))), lambda k: activity_backoff(k, base_secs, strategy))).otherwise(F.array().cast("array<bigint>"))
    waited = F.aggregate(waits, F.lit(0).cast("long"), lambda a, x: a + x)
    return best.select("call_id", F.col("_won").isNotNull().alias("succeeded"), (ended + 1).alias("attempts"), waited.alias("waited_secs"), F.when(F.col("_won").isNull(), F.col("_last")).alias("error"))


def execution_id(request: Column, how: str = "hash") -> Column:
    """A workflow's execution id: the digest of the request or of its key, or the key's own text."""
    return request.cast("string") if how == "raw" else digest_hex(request)


def timer_workflow(pending: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(fires, pending after): due timers leave; cancelled ones without a fire."""
    due_at = F.col("scheduled_at") + F.make_dt_interval(secs=F.col("delay_ms") / 1000)
    due = due_at <= as_of
    fires = pending.filter(due & ~F.col("cancelled")).select("entity_id", "timer_id", "scheduled_at", due_at.alias("fired_at"))
    return fires, pending.filter(~due)


def expired_workflow_rows(timers: DataFrame, deferred: DataFrame, cutoff: Column) -> DataFrame:
    """One row: fired timers created, and deferreds resolved, strictly before the cutoff, and their sum."""
    a = timers.agg(F.count_if(F.col("fired") & (F.col("created_at") < cutoff)).alias("timers"))
    b = deferred.agg(F.count_if(F.col("resolved") & (F.col("resolved_at") < cutoff)).alias("deferreds"))
    return a.crossJoin(b).withColumn("deleted", F.col("timers") + F.col("deferreds"))
