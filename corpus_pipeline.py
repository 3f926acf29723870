"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) with docs like documents (doc_id, text,
lang, source, n_chars), is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.llm.decontamination import drop_contaminated
from ticketspark.llm.language_id import fit, predict
from ticketspark.llm.near_duplicates import Plan, near_duplicates
from ticketspark.llm.packing import count_words, pack
from ticketspark.llm.pii import pseudonymise, session_key
from ticketspark.llm.scratch import drop, keep, written

BATCH_WORDS, BUCKETS = 16_384, 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters; fill in a missing lang where n-grams tell it.

    A null or empty text has no letters and goes, whatever its lang. Documents
    with a null doc_id are judged like others but not learned from. Repeated rows
    are each kept, long texts are read whole, further columns stay, and an empty
    table stays empty. Without any lang to learn from, all documents stay.
    """
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.where(third != 1).select(F.col("doc_id").alias("key"), "text", "lang"))
    if not model.languages:
        return docs
    # other columns travel as one, so none clashes with what is added
    boxed = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    known = predict(boxed, model).where(F.col("lang_pred") != "und")
    lang = F.coalesce("row.lang", F.when(F.col("score") > 0, F.col("lang_pred"))).alias("lang")
    return known.select(*[F.col("text") if c == "text" else lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate group (five words, similarity 0.8).

    Null and empty texts have no copies and stay. Rows that repeat a doc_id count
    as one document: the one with the least text, then the least other columns,
    stays. Rows with a null doc_id all stay. Long texts are compared whole,
    further columns stay, and an empty table stays empty.
    """
    ids = near_duplicates(docs, Plan(shingle=5)).where("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    named = docs.where("doc_id is not null")
    once = named.join(ids.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    # few rows, if any, share an id
    again = named.join(ids.where("rows > 1").select("doc_id"), "doc_id", "left_semi")
    plain = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and not t.startswith(("map", "variant"))]
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", *plain)).alias("row"))
    return once.select(*docs.columns).union(again.select(*[F.col(f"row.`{c}`") for c in docs.columns])).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ten words of a benchmark item.

    Null and empty texts hold none and stay; null items have no windows. Repeated
    rows are judged alike, long texts are scanned whole, further columns stay,
    and an empty table stays empty.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data under the session's key; n_chars is that of the new text.

    A null text stays null, with a null n_chars. Repeated rows are changed alike,
    long texts are read whole, further columns stay, and an empty table stays empty.
    """
    boxed = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    changed = pseudonymise(boxed, session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*[F.col(c) if c in ("text", "n_chars") else F.col(f"row.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document, by its number of words.

    Null and empty texts have 0 words. Repeated rows and null ids each get a
    slot, a text over the budget is whole in a batch of its own, other columns
    are left out, and an empty table stays empty.
    """
    return pack(docs.select("doc_id", count_words(F.col("text")).alias("n_words")), "n_words", BATCH_WORDS, BUCKETS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("replace_pii", replace_pii),
    ("packing", packing),
]

#: Language ID and the pseudonyms have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Of what they write, only what the last one reads stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(written())
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        drop(spark, [p for p in written()[:-1] if p not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
