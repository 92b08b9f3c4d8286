"""Inspection: recent rows, ordered listings, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import completion, in_prefix_range, optional


def recent_messages(messages: DataFrame, entity_type: str | None = None, entity_id: str | None = None, processed: bool | None = None, tag: str | None = None, limit: int = 100) -> DataFrame:
    """The newest messages that fit; ties by request id."""
    found = optional(messages, entity_type=entity_type, entity_id=entity_id, processed=processed, tag=tag)
    return found.orderBy(F.desc("created_at"), F.desc("request_id")).limit(limit)


def recent_replies(replies: DataFrame, request_id: int | None = None, is_exit: bool | None = None, limit: int = 100) -> DataFrame:
    found = optional(replies, request_id=request_id, is_exit=is_exit)
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_journal(journal: DataFrame, prefix: str | None = None, completed: bool | None = None, limit: int = 100) -> DataFrame:
    found = completion(journal if prefix is None else journal.filter(in_prefix_range("key", prefix)), completed)
    return found.orderBy(F.desc("updated_at"), F.desc("key")).limit(limit).withColumn("value_size", F.octet_length("value"))


def keys_with_prefix(journal: DataFrame, prefix: str) -> DataFrame:
    return journal.filter(in_prefix_range("key", prefix)).select("key").orderBy("key")


def history(rows: DataFrame, key: dict, order: list[str]) -> DataFrame:
    """Rows of one key in order."""
    return optional(rows, **key).orderBy(*order)


def count_where(rows: DataFrame, **wanted) -> DataFrame:
    return optional(rows, **wanted).agg(F.count("*").alias("n"))
