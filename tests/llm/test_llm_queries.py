import re
from collections import Counter

import numpy as np
import pytest
from compare import SF, connect, same_rows
from pyspark.sql import functions as F

from ticketspark.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, con, name):
    assert same_rows(QUERIES[name](spark, str(SF)), con, ORACLE_SQL[name])


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op4_language_id"](spark, str(SF)).join(docs, "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n and right >= 0.97 * n


def test_packing_pads_least(spark):
    """The query's padding is that of the plain recurrence over all lengths, and batches keep the budget."""
    folder = str(SF).replace("sf0.001", "sf0.01")
    rows = QUERIES["op10_packing"](spark, folder).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_words for r in rows} == words and all(r.padding == r.bucket_len - r.n_words >= 0 for r in rows)
    lengths, counts = np.unique([n for n in words.values() if n <= 16_384], return_counts=True)
    before, tokens = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(lengths * counts)))
    cost = np.concatenate(([0], lengths * before[1:] - tokens[1:]))
    for _ in range(15):
        cost = np.array([0, *(min(cost[j], min(cost[i] + lengths[j - 1] * (before[j] - before[i]) - tokens[j] + tokens[i] for i in range(j))) for j in range(1, len(lengths) + 1))])
    assert sum(r.padding for r in rows) == cost[-1]
    batches = Counter((r.bucket, r.batch, r.bucket_len) for r in rows)
    assert len({k[:2] for k in batches}) == len(batches) and all(n == 1 or n * size <= 16_384 for (_, _, size), n in batches.items())


def test_toxic_documents_held_out(spark):
    """Of the held-out labelled documents of sf0.01, nine of ten toxic ones are found, and few others."""
    folder = str(SF).replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    out = QUERIES["op6_toxicity"](spark, folder).join(labels, "doc_id").where("held_out")
    found, toxic, wrong, other = out.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic = 0 and predicted = 1")), F.count_if(F.expr("toxic = 0"))).first()
    assert toxic and found >= 0.9 * toxic and wrong <= 0.05 * other


def test_pseudonyms_of_all_documents(spark):
    """Digit runs and addresses that a plain reading finds are gone, and everything between them is as it was."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    plain = re.compile(r"[\w.+-]+@[\w-]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{3}-\d{2}-\d{4}\b|\b\d{16}\b")
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    changed = 0
    for r in QUERIES["op7_pii"](spark, str(SF)).collect():
        was = docs[r.doc_id]
        found = [m for m in plain.findall(was or "") if len(m) != 16 or luhn(m)]
        assert not any(re.search(rf"(?<!\w){re.escape(m)}(?!\w)", r.text) for m in found)
        assert r.n_pii >= len(found) and (r.text == was) == (r.n_pii == 0)
        changed += r.n_pii > 0
        letters = re.compile(r"[^\d\w@]")
        assert letters.findall(r.text or "") == letters.findall(was or "")
    assert changed


@pytest.mark.parametrize("name", ["op6_toxicity", "op7_pii", "op10_packing"])
def test_one_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = QUERIES[name](spark, str(SF))
    assert out.count() == n == out.select("doc_id").distinct().count()
