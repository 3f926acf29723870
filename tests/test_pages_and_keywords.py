"""Deep pages and the keyword index against plain sorts and scans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketspark.operators import pages, search
from ticketspark.operators.keyword_index import KeywordIndex
from ticketspark.operators.pages import deep_page
from ticketspark.sources.written import written


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    kind = lambda i: None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
    times = [None, *(datetime(2025, 1, 1) + timedelta(minutes=rng.randrange(300)) for _ in range(50))]
    return [(kind(i), rng.choice(times), i) for i in range(4000)] + [("hot", times[1], 5000)] * 30


def plain(rows, order):
    out = list(rows)
    for at, down in reversed(order):
        some = sorted((r for r in out if r[at] is not None), key=lambda r: r[at], reverse=down)
        out = some + [r for r in out if r[at] is None]
    return out


@pytest.mark.parametrize("order", [[("a", False), ("t", True), ("i", False)], [("t", False), ("i", True)], [("i", True)], [("a", True), ("i", False)]])
def test_pages_equal_a_sort_of_all(spark, rows, order):
    df = written(spark.createDataFrame(rows, "a string, t timestamp, i int").repartition(5))
    expected = plain(rows, [("ati".index(c), d) for c, d in order])
    for offset, size in ((0, 5), (1990, 40), (3995, 100), (5000, 3), (7, 0)):
        got = [tuple(r) for r in deep_page(df, order, offset, size, sort_rows=200).collect()]
        assert got == expected[offset : offset + size]


def test_only_a_range_is_sorted(spark, rows):
    df = written(spark.createDataFrame(rows, "a string, t timestamp, i int"))
    parts = pages._parts(df, [("i", False)], 3000, 10, len(rows), 200)
    assert len(parts) <= 2 and [r.i for p in parts for r in p.collect()] == list(range(3000, 3010))
    for p in parts:
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in plan and ">=" in plan


def test_pages_of_equal_rows_and_of_none(spark):
    df = spark.range(1000).select(F.lit(1).alias("x"))
    assert deep_page(df, [("x", False)], 900, 7, sort_rows=10).count() == 7
    assert deep_page(df.limit(0), [("x", False)], 0, 7).collect() == []


def test_a_deep_page_of_orders(spark, monkeypatch):
    monkeypatch.setattr(search, "DEEP", 100)
    df = spark.range(500).select(F.col("id").cast("string").alias("order_id"), F.lit("c").alias("content"), F.lit("t").alias("title"), F.lit("e").alias("extracted_event"), F.lit("a").alias("extracted_area"), F.lit("s").alias("extracted_subject"), (F.col("id") % 7).alias("cluster_id"), (F.col("id") % 5).alias("cluster_size"), F.lit(True).alias("is_multi_freq"), F.lit(None).cast("timestamp").alias("submit_time"))
    events = spark.createDataFrame([("EV1", 1, "e", 3)], "event_id string, cluster_id long, event_type string, frequency long")
    for sort, key in (("default", lambda i: (-(i % 5), str(i))), ("time", str)):
        page, total = search.orders_page(df, events, page=30, size=10, sort=sort)
        assert {r.order_id for r in page.collect()} == {str(i) for i in sorted(range(500), key=key)[290:300]} and total.first().total == 500


# --- keywords


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab 街道𝄞é") for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "a rare word: quixotic", "x" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "quixotic", 1)], "id long, t string, piece_of int")
    index = KeywordIndex(spark, str(tmp_path / "index"), "id", F.col("t"), pieces=16)
    index.add(df.where("id < 200 or id is null"))
    index.add(df.where("id >= 200"))
    for word in ("a", "街", "ab", "道𝄞", "abé", "街道", "quixotic", "b 街a", "xxxxxxx", "zzz", "aaaaaaaaaa", "word: quix"):
        assert sorted(r.id for r in index.search(word).collect()) == [i for i, t in enumerate(texts) if t and word in t]
    assert index.search("").count() == df.count()
    # a rare word's rows lie in one piece of sixteen, and no other is read
    assert len(index.pieces_of("quixotic")) == 1 and index.pieces_of("zzz") == [] and len(index.pieces_of("a")) == 16
    plan = index.search("quixotic")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(piece" in plan or "PartitionFilters: [piece" in plan or "piece" in plan.split("PartitionFilters")[1][:200]


def test_parts_name_rows_of_a_block_together(spark, tmp_path):
    df = spark.range(2000).select("id", F.concat(F.lit("ticket "), F.col("id") % 10).alias("t"))
    index = KeywordIndex(spark, str(tmp_path / "index"), "id", F.col("t"), pieces=4)
    index.add(df)
    parts = spark.read.parquet(str(tmp_path / "index" / "parts"))
    # far fewer rows than the 2,000 texts have parts, and each part names a row once
    assert parts.count() < 2000 and parts.where("size(ats) <> size(array_distinct(ats))").count() == 0
    assert index.search("et 7").columns == ["id", "t"] and sorted(r.id for r in index.search("et 7").collect()) == list(range(7, 2000, 10))
