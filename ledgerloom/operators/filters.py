"""Predicates of the runtime as column expressions, and the filters built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header that asks for a stream, unless a caller names another.
STREAM_HEADER = "x-stream"
#: Errors that are worth a retry.
RETRYABLE = ("EntityNotAssignedToRunner", "RunnerUnavailable")


def due(as_of: Column, deliver_at: str = "deliver_at") -> Column:
    return F.col(deliver_at).isNull() | (F.col(deliver_at) <= as_of)


def unprocessed() -> Column:
    return ~F.col("processed")


def unguarded(as_of: Column, guard_seconds: float, last_read: str = "last_read") -> Column:
    """Not read within the guard interval; a guard of 0 or less guards nothing."""
    if guard_seconds <= 0:
        return F.lit(True)
    return F.col(last_read).isNull() | (F.col(last_read) < as_of - F.make_dt_interval(secs=F.lit(guard_seconds)))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every argument that is not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def completion(df: DataFrame, completed: bool | None, column: str = "completed_at") -> DataFrame:
    """All rows with None, else those that are (or are not) completed."""
    return df if completed is None else df.filter(F.col(column).isNotNull() if completed else F.col(column).isNull())


def like_prefix(column: str, prefix: str) -> Column:
    """LIKE prefix%; wildcards in the prefix keep their meaning."""
    return F.col(column).like(prefix + "%")


def prefix_upper_bound(prefix: str) -> str | None:
    """The least text above all that begin with `prefix` in byte order; None when there is none that is text."""
    raw = bytearray(prefix.encode())
    while raw:
        if raw[-1] < 0xFF:
            raw[-1] += 1
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        raw.pop()
    return None


def in_prefix_range(column: str, prefix: str) -> Column:
    """The half-open byte range of a prefix, which a sorted source can skip by."""
    if not prefix:
        return F.lit(True)
    upper = prefix_upper_bound(prefix)
    low = F.col(column) >= prefix
    return low if upper is None else low & (F.col(column) < upper)


def by_ids(messages: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Unprocessed, due messages of the given request ids; the read guard does not apply."""
    return messages.filter(unprocessed() & due(as_of)).join(ids.select("request_id").distinct(), "request_id", "left_semi")


def assignable(runners: DataFrame) -> DataFrame:
    return runners.filter("healthy and weight > 0")


def is_stream_request(headers: str = "headers", name: str = STREAM_HEADER) -> Column:
    """Whether the header `name`, which a deployment chooses, is "1"."""
    return F.coalesce(F.col(headers)[name] == "1", F.lit(False))


def suppresses_reply(internal: Column, persisted: Column, mode: str = "uninterruptible") -> Column:
    """An internal interrupt of a persisted request that the server side must not interrupt gets no reply."""
    return internal & persisted & F.col(mode).isin("Server", "Both")


def is_retryable(error: str) -> Column:
    return F.col(error).isin(*RETRYABLE)


def interrupt_mode(text: str) -> Column:
    """A known mode, else No."""
    return F.when(F.col(text).isin("Client", "Server", "Both"), F.col(text)).otherwise("No")


def dead_lettered(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Processed messages whose exit reply has the negative id of a dead letter."""
    letters = replies.filter("is_exit and id < 0").select("request_id")
    return messages.filter("processed").join(letters, "request_id", "left_semi")


def clear_replies(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Replies without those of the given requests."""
    return replies.join(requests.select("request_id").distinct(), "request_id", "left_anti")


def acknowledge(replies: DataFrame, acks: DataFrame) -> DataFrame:
    """Replies without the acknowledged chunks; an exit is never acknowledged away."""
    key = ["request_id", "sequence", "id"]
    gone = replies.filter("not is_exit").join(acks.select(*key).distinct(), key, "left_semi").select(*key)
    return replies.join(gone.withColumn("_gone", F.lit(True)), key, "left").filter("_gone is null or is_exit").select(replies.columns)


def in_shards(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of the given shards; Spark broadcasts the shards when they are below its threshold."""
    return rows.join(shards.select("shard_group", "shard_id").distinct(), ["shard_group", "shard_id"], "left_semi")
