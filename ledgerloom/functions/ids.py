"""Shards, snowflake ids, machine ids and reply ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import djb2_fast

#: 2025-01-01T00:00:00Z in ms, and the field widths of a snowflake id.
EPOCH_MS, MACHINE_BITS, SEQUENCE_BITS = 1_735_689_600_000, 10, 12
MAX_DRIFT_MS = 5000


def shard_of(entity_id: Column, shards: int) -> Column:
    """The 0-based shard of an entity id."""
    if shards < 1:
        raise ValueError(f"shards must be >= 1, got {shards}")
    return F.pmod(djb2_fast(entity_id), F.lit(shards)).cast("int")


def snowflake_parts(id_: Column) -> Column:
    return F.struct(
        (F.shiftright(id_, MACHINE_BITS + SEQUENCE_BITS) + EPOCH_MS).alias("timestamp_ms"),
        F.shiftright(id_, SEQUENCE_BITS).bitwiseAND((1 << MACHINE_BITS) - 1).cast("int").alias("machine_id"),
        id_.bitwiseAND((1 << SEQUENCE_BITS) - 1).cast("int").alias("sequence"),
    )


def snowflake(timestamp_ms: Column, machine_id: Column, sequence: Column) -> Column:
    return F.shiftleft(timestamp_ms - EPOCH_MS, MACHINE_BITS + SEQUENCE_BITS).bitwiseOR(F.shiftleft(machine_id.cast("long"), SEQUENCE_BITS)).bitwiseOR(sequence.cast("long"))


def wrap_machine_id(n: Column) -> Column:
    return F.pmod(n, F.lit(1 << MACHINE_BITS)).cast("int")


def valid_machine_id(n: Column) -> Column:
    return n.between(0, (1 << MACHINE_BITS) - 1)


def dead_letter_reply_id(request_id: Column) -> Column:
    return -request_id


HOUR_MS = 3_600_000


def generate(requests: DataFrame, machine: str, at_ms: str, order: list[str]) -> DataFrame:
    """`requests` with column id: snowflakes numbered within (machine, millisecond) by `order`.

    A millisecond holds 4096 ids; the rest move to the following milliseconds, as a waiting generator does, and
    so do the ids of a millisecond that earlier ones have run into.  The overflow is carried as the running
    maximum of "first free slot" over slots of 1/4096 ms, which needs no loop: slot(n) = n + max(start(k) - k).
    Rows are numbered within an hour of a machine; one row for each hour carries numbers and maximum to the next,
    so no task holds all that a machine ever did.
    """
    slots = 1 << SEQUENCE_BITS
    hour = F.floor(F.col(at_ms) / HOUR_MS)
    w = Window.partitionBy(machine, "_hour").orderBy(at_ms, *order)
    numbered = requests.withColumn("_hour", hour).withColumn("_n", (F.row_number().over(w) - 1).cast("long"))
    numbered = numbered.withColumn("_free", (F.col(at_ms) - EPOCH_MS) * slots - F.col("_n"))
    past = Window.partitionBy(machine).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = numbered.groupBy(machine, "_hour").agg(F.count("*").alias("_rows"), F.max("_free").alias("_most"))
    hours = hours.withColumn("_before", F.coalesce(F.sum("_rows").over(past), F.lit(0)))
    hours = hours.withColumn("_carried", F.max(F.col("_most") - F.col("_before")).over(past)).drop("_rows", "_most")
    met = numbered.join(hours, [machine, "_hour"])
    own = F.max("_free").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_before")
    slot = met.withColumn("_slot", F.greatest(own, "_carried") + F.col("_before") + F.col("_n"))
    made = snowflake(F.floor(F.col("_slot") / slots).cast("long") + EPOCH_MS, wrap_machine_id(F.col(machine)), F.pmod("_slot", F.lit(slots)))
    return slot.withColumn("id", made).select(*requests.columns, "id")


def with_drift(readings: DataFrame, machine: str, at_ms: str, order: list[str], most: int = MAX_DRIFT_MS) -> DataFrame:
    """`readings` of machines' clocks with used_ms and outcome, in `order`.

    A generator never goes back: a reading before the latest one that it has used waits for that ("wait"), up to
    `most` milliseconds; a larger step back is an error ("error", used_ms null), and the generator keeps what it had.
    """
    before = F.max(at_ms).over(Window.partitionBy(machine).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    late = F.coalesce(before - F.col(at_ms), F.lit(0).cast("long"))
    outcome = F.when(late > most, "error").when(late > 0, "wait").otherwise("ok")
    return readings.withColumn("used_ms", F.when(late <= most, F.greatest(F.col(at_ms), before))).withColumn("outcome", outcome)


def allocate_machine_ids(registrations: DataFrame, order: list[str], counter: int = 0) -> DataFrame:
    """`registrations` with column machine_id: a shared counter, plus one for each registration, wrapped.

    Registrations are few (one for each runner that joins), and the counter is global by definition.
    """
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + counter
    return registrations.withColumn("machine_id", wrap_machine_id(n))
