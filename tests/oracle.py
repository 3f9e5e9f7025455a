"""Compare a Spark result with DuckDB's for the same query."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def plain(x):
    """A value that compares equal across the two engines."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both have the same columns and rows."""
    got = rows(df.columns, df.collect())
    want_rel = con.sql(sql)
    if sorted(df.columns) != sorted(want_rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_rel.columns)}"
    want = rows(want_rel.columns, want_rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None
