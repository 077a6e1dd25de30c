"""Exact comparison of a Spark result with a DuckDB result: columns by name, rows in any order."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _cell(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        x = float(v)
        if math.isnan(x):
            return "nan"
        x = x + 0.0 if digits is None else round(x, digits) + 0.0
        return x
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(x, digits)) for k, x in sorted(v.items()))
    return v


def rows_of(columns, rows, digits: int | None = None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i], digits) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str, digits: int | None = None) -> str | None:
    """None where equal, else a short description of the first difference."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()], digits)
    rel = con.execute(sql)
    want_names, want = rows_of([d[0] for d in rel.description], rel.fetchall(), digits)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(got_names, a, b) if x != y]
            n_bad = sum(1 for p, q in zip(got, want) if p != q)
            return f"{n_bad} rows differ; first: {diff[:4]} in {a[:6]}"
    return None
