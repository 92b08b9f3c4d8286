"""Ages in whole seconds and milliseconds against DuckDB, with times between two ticks."""

from datetime import datetime, timedelta

import duckdb
import pytest

from ledgerloom.queries import QUERIES, SQL

AS_OF = datetime(2024, 1, 20)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def same(spark, tmp_path):
    """Checks a query on events (ts, user_id, event_type) against its statement; returns its rows."""

    def check(name, *rows):
        path = f"{tmp_path}/events.parquet"
        table = [(k, ts, user, kind, 0.0, "{}") for k, (ts, user, kind) in enumerate(rows)]
        spark.createDataFrame(table, EVENTS).write.parquet(path)
        con = duckdb.connect()
        con.sql(f"create view events as select * from '{path}/*.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        order = sorted(got.columns)
        want = con.sql(f"select {', '.join(order)} from ({SQL[name]})").fetchall()
        found = [tuple(r) for r in got.select(order).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
        return found

    return check


def ago(seconds):
    return AS_OF - timedelta(seconds=seconds)


def test_cron_age_between_two_ticks(same):
    ages = (86399.5, 86400, 86400.000001, 86400.9, 86401, -0.5, 2_000_000_000.5)
    got = same("B14_cron_staleness", *((ago(a), 1, "view") for a in ages), (None, 1, "view"))
    assert [v for _, v in sorted(got)] == ["run", "run", "skip", "skip", "skip", "run", "skip", "run"]


def test_idle_age_between_two_ticks(same):
    ages = (7199, 7199.000001, 7199.5, 7200, 7200.5, 9000)
    got = same("E13_idle_entities", *((ago(a), 10 + k, "view") for k, a in enumerate(ages)), (ago(9000), None, "view"), (ago(9000), 3, "view"))
    assert {e for e, _ in got} == {f"user-{k}" for k in range(11, 16)}


def test_recovery_between_two_ticks(same):
    down = [(ago(9000), 1, "error"), (ago(8999), 1, "error")]
    got = same("E24_detachment", *down, (ago(8000.0001), 1, "view"), (ago(4400.0009), 1, "view"), (ago(4400.0005), 1, "view"), (ago(4399), 1, "view"))
    assert sorted((ts, t) for _, t, ts in got) == [(ago(8999), "detach"), (ago(4400.0009), "attach")]
