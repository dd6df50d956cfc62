"""Comparison of a query's rows with DuckDB's."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"create view {name.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "item") or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def rows_of(frame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr([_cell(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


#: Queries whose result may be empty on the small tables.
MAY_BE_EMPTY = {"s2_empty_documents"}


def same(spark_frame, sql: str, sf_dir: str, may_be_empty: bool = False) -> None:
    mine, theirs = spark_frame.toPandas(), connection(sf_dir).sql(sql).df()
    assert len(theirs) or may_be_empty
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)
