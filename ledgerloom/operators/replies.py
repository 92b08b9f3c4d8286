"""Replies: order, reassembly of streams, polling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(replies: DataFrame) -> DataFrame:
    """Replies with column position in their request: chunks by sequence, then id; exits last."""
    w = Window.partitionBy("request_id").orderBy("is_exit", "sequence", "id")
    return replies.withColumn("position", F.row_number().over(w))


def reassemble(chunks: DataFrame, arrival: str = "arrival") -> DataFrame:
    """(request_id, position, sequence, value, phase) of the values a stream yields, in order.

    `chunks` has request_id, sequence, `values` (array) and an arrival order.  Chunks are emitted in consecutive
    sequence from 0.  Gaps are buffered; of a sequence that arrives again while it is buffered the last value
    counts, and one that arrives after it was emitted is dropped.  An empty chunk neither is emitted nor moves
    the expected sequence, so what follows waits for the close, when all that is buffered is emitted in order.

    A sequence s is emitted at the arrival that completes 0..s, the running maximum of first arrivals; so a
    repeat counts only when it came no later than that.
    """
    full = chunks.filter(F.size("values") > 0)
    first = full.groupBy("request_id", "sequence").agg(F.min(arrival).alias("_first"))
    w = Window.partitionBy("request_id").orderBy("sequence")
    ready = first.withColumn("_n", F.row_number().over(w) - 1).withColumn("_at", F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ready = ready.withColumn("phase", F.when(F.col("sequence") == F.col("_n"), "stream").otherwise("close"))
    in_time = full.join(ready, ["request_id", "sequence"]).filter((F.col("phase") == "close") | (F.col(arrival) <= F.col("_at")))
    kept = in_time.groupBy("request_id", "sequence", "phase").agg(F.max_by("values", arrival).alias("values"))
    each = kept.select("request_id", "sequence", "phase", F.posexplode("values").alias("part", "value"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("sequence", "part")) - 1
    return each.select("request_id", place.alias("position"), "sequence", "value", "phase")


def chunked(values: DataFrame, order: list[str], value: str) -> DataFrame:
    """A handler's values as chunks: sequence from 0, one value each."""
    n = F.row_number().over(Window.partitionBy("request_id").orderBy(*order)) - 1
    return values.select("request_id", n.alias("sequence"), F.array(value).alias("values"))


def poll(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """`requests` with column outcome: pending without an exit, else value or error."""
    exits = replies.filter("is_exit").select("request_id", F.col("payload").alias("reply"), (F.col("id") < 0).alias("_dead"))
    outcome = F.when(F.col("_dead").isNull(), "pending").when(F.col("_dead"), "error").otherwise("value")
    return requests.join(exits, "request_id", "left").select(*requests.columns, "reply", outcome.alias("outcome"))


def fallback(sent: DataFrame, polls: DataFrame, order: list[str]) -> DataFrame:
    """What a caller gets that polls after a lost connection: polls repeat chunks until the exit, once each."""
    key = ["request_id", "sequence"]
    rest = [c for c in polls.columns if c not in key]
    once = polls.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    fresh = once.join(sent.select(*key).distinct(), key, "left_anti")
    return fresh.select(*key, *(F.col("_r")[c].alias(c) for c in rest)).select(polls.columns)
