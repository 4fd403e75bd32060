"""Comparison of a query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def _cell(v: object) -> object:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(float(v)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))


def check(spark, sf_dir: str, query, sql: str) -> None:
    got = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
