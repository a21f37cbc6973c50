"""Holds queries against their SQL in DuckDB, on the driver's tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x.replace(tzinfo=None)) if hasattr(x, "tzinfo") else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    out = con.execute(sql)
    return rows_of([c[0] for c in out.description], out.fetchall())


def difference(df, sql: str, sf_dir: str) -> str:
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    wanted_names, want = oracle(sql, sf_dir)
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} and {len(want)} rows; only here {sorted(a)[:2]}; only in SQL {sorted(b)[:2]}"
    return ""
