"""The keyed table in files: buckets, versions, ties and writers at once."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ticketspark.sources.keyed_table import KeyedTable
from ticketspark.streaming.incremental import clean_into


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(f"{path}/rows") for n in names if n.endswith(".parquet")}


def rows(spark, values):
    return spark.createDataFrame(values, "k string, j int, v string, version int")


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], buckets=8)


def got(table, number=None):
    return {(r.k, r.j): (r.v, r.version) for r in table.read(number).collect()}


def test_a_batch_rewrites_only_its_buckets(spark, table):
    assert table.number() == 0 and table.read() is None
    table.upsert(rows(spark, [(f"k{i}", i % 3, "a", 1) for i in range(200)]))
    before, first = files(table.path), table.read()
    assert table.upsert(rows(spark, [("k5", 2, "b", 2), ("new", 0, "b", 1)])) == 2
    kept = before & files(table.path)
    assert before == kept  # nothing that a reader may have open goes
    touched = [b for b, m in table.folders(2).items() if m != table.folders(1).get(b)]
    assert 1 <= len(touched) <= 2
    assert got(table)[("k5", 2)] == ("b", 2) and len(got(table)) == 201
    # the first version is still read as it was
    assert first.count() == 200 and got(table, 1)[("k5", 2)] == ("a", 1)
    table.drop_old()
    now = files(table.path)
    assert {f for f in before if not any(f"bucket={b}/" in f for b in touched)} <= now and len(got(table)) == 201
    assert os.listdir(f"{table.path}/batches") == []


def test_versions_and_ties(spark, table):
    table.upsert(rows(spark, [("a", 0, "old", 2), ("b", 0, "old", 2), ("c", 0, "old", None), (None, 0, "null", 1)]))
    table.upsert(rows(spark, [("a", 0, "lower", 1), ("b", 0, "x", 2), ("b", 0, "y", 2), ("b", 0, "y", 2), ("c", 0, "new", 1), (None, 0, "null key", 3)]))
    assert got(table) == {("a", 0): ("old", 2), ("b", 0): ("y", 2), ("c", 0): ("new", 1), (None, 0): ("null key", 3)}
    # an empty batch makes no version
    assert table.upsert(rows(spark, []).limit(0)) == 2
    # other columns are null where a batch lacks them
    table.upsert(rows(spark, [("d", 0, "more", 1)]).withColumn("extra", F.lit(7)))
    assert {r.k: r.extra for r in table.read().collect()} == {"a": None, "b": None, "c": None, None: None, "d": 7}


def test_of_two_writers_of_a_version_one_fails(spark, table, monkeypatch):
    table.upsert(rows(spark, [("a", 0, "first", 1)]))
    other = KeyedTable(spark, table.path, ["k", "j"], buckets=8)
    number = table.number()
    other.upsert(rows(spark, [("a", 0, "second", 2)]))
    monkeypatch.setattr(table, "number", lambda: number)
    with pytest.raises(FileExistsError):
        table.upsert(rows(spark, [("a", 0, "third", 3)]))
    assert got(other) == {("a", 0): ("second", 2)}


def test_cleaning_into_the_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["ticket_no", "job_id"], buckets=4)
    new = lambda *x: spark.createDataFrame(list(x), "ticket_no string, job_id string, content string").withColumn("content_hash", F.md5("content"))
    seen = []

    def clean(df):
        seen.append(df.count())
        return df.withColumns({"content": F.upper("content"), "version": F.lit(len(seen))})

    clean_into(table, new(("1", "j", "a"), ("2", "j", "b")), clean)
    clean_into(table, new(("1", "j", "a"), ("2", "j", "c"), ("3", "j", "d")), clean)
    assert seen == [2, 2] and {(r.ticket_no, r.content) for r in table.read().collect()} == {("1", "A"), ("2", "C"), ("3", "D")}
