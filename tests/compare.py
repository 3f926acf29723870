"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def same_rows(df, con, sql: str) -> bool:
    names = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in names]) for r in df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    return got == Counter(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
