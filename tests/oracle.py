"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)) or hasattr(x, "__float__"):
        return None if math.isnan(float(x)) else round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


def differences(df, sql: str, sf: str) -> str:
    """Empty if columns and rows are the same."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in got.fetchall()), key=key)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    if len(have) != len(want):
        return f"{len(have)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""
