"""Ids and journal keys over Arrow batches."""

import pytest
from pyspark.sql import functions as F
from test_growth import plan
from test_hashing import M, djb2

from ledgerloom.functions import hashing as H
from ledgerloom.queries import QUERIES


@pytest.mark.parametrize("name", ["C9_journal_replay", "S14_journal_key", "S5_persisted_request_id", "S6_fallback_reply_id"])
def test_ids_are_hashed_in_batches(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "ArrowEvalPython" in text and "aggregate(" not in text


def test_ids_of_binaries_and_nulls(spark):
    keys = [b"", b"\0", b"User\0e\0tag\0\xff\xfe", None, b"x" * 3000]
    got = [r["h"] for r in spark.createDataFrame([(k, k) for k in keys], "k binary, j binary").coalesce(1).select(H.djb2_id(F.col("k")).alias("h")).collect()]
    assert got == [None if k is None else djb2(k) & (M >> 1) for k in keys]
    e = spark.createDataFrame([("T", None)], "t string, n string")
    assert e.select(H.persisted_request_id(F.col("t"), F.col("n"), F.col("t"), F.col("t")).alias("h")).first()["h"] is None
