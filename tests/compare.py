"""Order-free comparison of a Spark result with a DuckDB result."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    if isinstance(v, str):
        return v
    try:
        return repr(round(float(v), 9))
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None))


def assert_same(df, con, sql):
    assert rows(df.toPandas()) == rows(con.sql(sql).df())
