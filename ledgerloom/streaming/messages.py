"""Streams over the message log: idempotent inserts, polling, reassembly, detachment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.messages import Claim, claim


def table_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Rows appended to a Parquet table; `files_per_trigger` is the back-pressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder of a Parquet table; a batch that is replayed replaces itself."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def runner_snapshots(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runner changes (host, port, weight, healthy, seq): after every batch `sink` gets the full registry.

    The registry is kept in state by the streaming aggregate; complete mode hands all of it on.
    """
    latest = stream.groupBy("host", "port").agg(F.max_by(F.struct("weight", "healthy"), "seq").alias("r")).select("host", "port", "r.weight", "r.healthy")
    return latest.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_writers(stream: DataFrame, key: list[str], event_time: str, keep: str) -> DataFrame:
    """Insert-ignore on a stream: the first row of a key passes, repeats within `keep` are dropped."""
    return stream.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(key)


def polls(ticks: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], sink: Callable[[Claim, int], None], checkpoint: str, limit: int = 1000, max_retries: int = 10, guard_seconds: float = 600) -> StreamingQuery:
    """Poll the log once for each batch of `ticks` (column as_of): claim, and hand the result to `sink`.

    `tables` gives messages, replies and owned shards as they are at the poll; the sink writes the result back.  The
    batch number lets a sink that is called again after a failure recognise what it has already written.
    """

    def each(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("as_of").alias("t")).first()["t"]
        if now is not None:
            messages, replies, shards = tables()
            sink(claim(messages, replies, shards, F.lit(now).cast("timestamp_ntz"), limit, max_retries, guard_seconds), number)

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --------------------------------------------------------------------------- reassembly
EMITTED = "request_id long, position long, sequence int, value string, phase string"
PENDING = "next int, position long, sequences array<int>, parts array<array<string>>"


def reassemble(stream: DataFrame) -> DataFrame:
    """Values of chunked replies in order, as they become complete.

    Rows: request_id, sequence, `values` array<string>, arrival, close boolean.  Within a batch a request's rows
    are taken by arrival.  State is the next sequence and what is buffered beyond it; a close row flushes the
    buffer in order and forgets the request.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, position, held = 0, 0, {}
        if state.exists:
            expected, position, sequences, parts = state.get
            held = dict(zip(sequences, map(list, parts)))
        out: list[tuple] = []

        def emit(sequence: int, values: list[str], phase: str) -> None:
            nonlocal position
            for v in values:
                out.append((key[0], position, sequence, v, phase))
                position += 1

        closed = False
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        for sequence, values, close in zip(rows["sequence"], rows["values"], rows["close"]):
            if close:
                for k in sorted(held):
                    emit(k, held[k], "close")
                held, closed = {}, True
            elif len(values) and sequence >= expected and not closed:
                held[int(sequence)] = list(values)
                while expected in held:
                    emit(expected, held.pop(expected), "stream")
                    expected += 1
        if closed:
            state.remove()
        else:
            state.update((expected, position, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["request_id", "position", "sequence", "value", "phase"])

    return stream.groupBy("request_id").applyInPandasWithState(step, EMITTED, PENDING, "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------- detachment
def detachments(stream: DataFrame, recover_ms: int, threshold: int) -> DataFrame:
    """(runner, ts, transition) of health signals (runner, ts, healthy), taken by ts within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detached, failures, since = state.get if state.exists else (False, 0, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, healthy in zip(rows["ts"], rows["healthy"]):
            now = int(pd.Timestamp(ts).value // 1_000_000)
            if not healthy:
                failures, since = failures + 1, None
                if failures >= threshold and not detached:
                    detached = True
                    out.append((key[0], ts, "detach"))
                continue
            failures = 0
            if since is None:
                since = now
            elif detached and now - since >= recover_ms:
                detached = False
                out.append((key[0], ts, "attach"))
        state.update((detached, failures, since))
        yield pd.DataFrame(out, columns=["runner", "ts", "transition"])

    return stream.groupBy("runner").applyInPandasWithState(step, "runner long, ts timestamp_ntz, transition string", "detached boolean, failures int, since long", "append", GroupStateTimeout.NoTimeout)


def due_timers(stream: DataFrame, sink: Callable[[DataFrame, int], None], stored: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Durable sleeps from a stream of requests: a timer that is stored keeps its time, others are new.

    `sink` gets each batch's timers (workflow_name, execution_id, timer_name, fire_at, fired) as of the batch's latest seq time.
    """
    from ..operators.workflow import sleep

    def each(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("asked_at").alias("t")).first()["t"]
        if now is not None:
            sink(sleep(stored(), batch, F.lit(now).cast("timestamp_ntz"), ["asked_at"]), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
