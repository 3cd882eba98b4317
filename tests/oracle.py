"""Compare a registered query with its SQL on DuckDB, without regard to row order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def views(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        name = os.path.basename(p).removesuffix(".parquet")
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(cols: list[str], data: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, d: str, query, sql: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} rows against {len(want[1])}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return ""
