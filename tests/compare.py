"""Compares a query with its SQL on DuckDB, as rows without order."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r.asDict()[c]) for c in cols)) for r in df.collect())


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
