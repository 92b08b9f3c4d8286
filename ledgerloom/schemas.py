"""Schemas of the runtime's tables as Spark DDL, and checks of their constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An exit reply's sequence number, so that a request has one exit at most.
EXIT_SEQUENCE = 2147483647

MESSAGES = (
    "request_id BIGINT, shard_group STRING, shard_id INT, entity_type STRING, entity_id STRING, tag STRING, payload BINARY, "
    "headers STRING, processed BOOLEAN, retry_count INT, created_at TIMESTAMP_NTZ, deliver_at TIMESTAMP_NTZ, last_read TIMESTAMP_NTZ, uninterruptible STRING"
)
REPLIES = "id BIGINT, request_id BIGINT, sequence INT, payload STRING, is_exit BOOLEAN, created_at TIMESTAMP_NTZ"
JOURNAL = "key STRING, value STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ"
TIMERS = "workflow_name STRING, execution_id STRING, timer_name STRING, fire_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, fired BOOLEAN"
DEFERRED = "workflow_name STRING, execution_id STRING, deferred_name STRING, value STRING, resolved BOOLEAN, created_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ"
RUNNERS = "host STRING, port INT, weight INT, healthy BOOLEAN"
SHARDS = "shard_group STRING, shard_id INT"
LOCKS = "shard_group STRING, shard_id INT, owner STRING"

#: Interrupt modes.
INTERRUPT_MODES = ("No", "Client", "Server", "Both")

KEYS = {
    "messages": ["request_id"],
    "replies": ["request_id", "sequence"],
    "journal": ["key"],
    "timers": ["workflow_name", "execution_id", "timer_name"],
    "deferred": ["workflow_name", "execution_id", "deferred_name"],
    "runners": ["host", "port"],
    "locks": ["shard_group", "shard_id"],
}

CHECKS = {
    "messages": {"retry_count": "retry_count >= 0", "uninterruptible": "uninterruptible is null or uninterruptible in ('No', 'Client', 'Server', 'Both')"},
    "replies": {"exit_sequence": f"not is_exit or sequence = {EXIT_SEQUENCE}"},
    "runners": {"weight": "weight >= 0"},
}


def violations(table: DataFrame, name: str) -> DataFrame:
    """(check, n): how many rows break each constraint of `name`, among them the key's uniqueness."""
    key = KEYS[name]
    checks = CHECKS.get(name, {})
    counts = table.agg(*(F.count_if(~F.expr(c)).alias(k) for k, c in checks.items()), F.count("*").alias("_rows"))
    stacked = counts.select(F.explode(F.create_map(*(x for k in checks for x in (F.lit(k), F.col(k))), F.lit("_rows"), F.col("_rows"))).alias("check", "n")).filter("check <> '_rows'")
    repeats = table.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("key").alias("check"), F.count("*").alias("n"))
    return stacked.unionByName(repeats)
