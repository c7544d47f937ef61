"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the sorted values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], values: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in values]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty string, or what differs."""
    a = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] == b[1]:
        return ""
    left, right = set(a[1]) - set(b[1]), set(b[1]) - set(a[1])
    return f"{len(a[1])} and {len(b[1])} rows; only in Spark {sorted(left, key=repr)[:2]}, only in SQL {sorted(right, key=repr)[:2]}"
