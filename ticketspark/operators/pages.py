"""Deep pages of a sorted table: counts by ranges say where a page lies, and only that range is sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of one round of counting, values sampled to part them, and rows that are sorted at most.
RANGES, SAMPLE, SORT_ROWS = 128, 2000, 50_000

Order = Sequence[tuple[str, bool]]


def _sorted_by(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]


def _parts(df: DataFrame, order: Order, offset: int, size: int, n: int, sort_rows: int) -> list[DataFrame]:
    """The rows from offset on of df's n rows, as frames of size rows at most in all, in order of each other."""
    if size <= 0 or offset >= n:
        return []
    if not order:  # rows that are equal in all columns of the order stand in any
        return [df.limit(size)]
    if n <= sort_rows:
        return [df.orderBy(*_sorted_by(order)).offset(offset).limit(size)]
    (name, down), rest = order[0], order[1:]
    c = F.col(name)
    sample = df.select(name).where(c.isNotNull()).sample(min(1.0, 2 * SAMPLE / n), seed=1).limit(SAMPLE).collect()
    values = sorted(r[0] for r in sample)
    bounds = sorted({values[i * len(values) // RANGES] for i in range(RANGES)}) if values else []
    # range i has values from bounds[i - 1] up to bounds[i]
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c)) if bounds else F.lit(0)
    rows = df.groupBy(F.when(c.isNotNull(), at).alias("range")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect()
    rows.sort(key=lambda r: (r["range"] is None, (-1 if down else 1) * (r["range"] or 0)))
    out, before = [], 0
    for r in rows:
        skip = max(0, offset - before)
        take = min(r.n - skip, offset + size - max(before, offset))
        if take > 0:
            inside = c.isNull() if r["range"] is None else (c >= F.lit(r.low)) & (c <= F.lit(r.high))
            same = r["range"] is None or r.low == r.high
            out += _parts(df.where(inside), rest if same else order, skip, take, r.n, sort_rows)
        before += r.n
        if before >= offset + size:
            break
    return out


def deep_page(df: DataFrame, order: Order, offset: int, size: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """The size rows from offset on in the order of columns (name, whether downwards), nulls last, as a sort of all rows would give them.

    A round counts the rows of some ranges of the first column, in one scan; ranges that hold a
    part of the page are parted again, by the next column where a range is one
    value, until sort_rows or fewer are left, which are sorted. The driver sees
    counts and bounds of ranges alone. df is read once a round, so it should be a table in files; its
    statistics then let later rounds pass over what lies elsewhere.

    Columns are of any type that can be sorted and given as a literal. Rows equal in all of them may come in any order.
    """
    parts = _parts(df, list(order), offset, size, df.count(), sort_rows)
    out = df.limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out.orderBy(*_sorted_by(order))
