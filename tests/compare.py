"""Compares a query's rows with those of its SQL in DuckDB, order aside."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from loomgraph.plans.model import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 5) + 0.0
    return str(value)[:19]


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = [tuple(_plain(r[k]) for k in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if columns, row count and values agree."""
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows against {len(theirs)}; e.g. {[r for r in ours if r not in set(theirs)][:2]} / {[r for r in theirs if r not in set(ours)][:2]}"]
    return [f"{a} against {b}" for a, b in zip(ours, theirs) if a != b][:3]
