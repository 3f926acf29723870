"""Language ID by a bit-sliced Bloom filter: one lookup returns all languages that contain an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .textops import U64, chunks, mix, small_batches

#: Bytes in an n-gram, with the spaces at a word's ends.
NGRAM = 5
#: Hash functions of the filter, and slots for each n-gram it holds.
HASHES, SLOTS_EACH = 3, 12
#: A language contains an n-gram that this share of its documents have ...
MIN_SHARE = 0.01
#: ... if no other language's share is so many times as large.
MAX_RATIO = 8.0
#: Labelled rows that the n-grams are learned from, as expected under hash sampling.
TRAINING_ROWS = 20_000

_SPACE = 0x20
#: Letters in lower case; other ASCII becomes a space.
_LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else _SPACE for b in range(256)], np.uint8)


def ngrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each n-gram of texts given by bytes and offsets, and its text's index.

    Runs of spaces count as one; texts are padded by a space at both ends.
    """
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts + 2)
    padded = np.full(len(raw) + 2 * len(counts), _SPACE, np.uint8)
    padded[np.arange(len(raw)) + 2 * np.repeat(np.arange(len(counts)), counts) + 1] = _LETTERS[raw]
    inside = padded != _SPACE
    take = inside.copy()
    take[1:] |= inside[:-1]  # the space after a word stays
    begins = np.ones(len(text), bool)
    begins[1:] = text[1:] != text[:-1]
    take |= begins
    padded, text = padded[take], text[take]
    n = len(padded) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    code = np.zeros(n, U64)
    for i in range(NGRAM):
        code |= padded[i : i + n].astype(U64) << U64(8 * i)
    whole = text[:n] == text[NGRAM - 1 :]
    return code[whole], text[:n][whole]


@dataclass
class Filter:
    """masks[plane, slot] has bit i for language 64 * plane + i; false_rate is a language's chance that an unknown n-gram seems known."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], codes: np.ndarray, language: np.ndarray) -> Filter:
        slots = 1 << max(10, int(SLOTS_EACH * max(1, len(np.unique(codes)))).bit_length())
        planes = -(-max(1, len(languages)) // 64)
        kind = np.uint8 if len(languages) <= 8 else U64
        out = cls(languages, np.zeros((planes, slots), kind), np.zeros(len(languages)))
        for where in out.slots(codes):
            for i in range(len(languages)):
                out.masks[i // 64, where[language == i]] |= kind(1 << (i % 64))
        for i in range(len(languages)):
            out.false_rate[i] = np.mean((out.masks[i // 64] >> kind(i % 64)) & kind(1)) ** HASHES
        return out

    def slots(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(codes)
        step = mix(h) | U64(1)
        for _ in range(HASHES):
            yield (h & U64(self.masks.shape[1] - 1)).astype(np.int64)
            h = h + step

    def known(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each plane, the languages that seem to contain each n-gram."""
        out: list[np.ndarray] = []
        for where in self.slots(codes):
            found = [plane[where] for plane in self.masks]
            out = [a & b for a, b in zip(out, found, strict=True)] if out else found
        return out

    def shares(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams that each language contains, corrected for false positives."""
        codes, text = ngrams(raw, at)
        n = len(at) - 1
        planes = self.known(codes)
        total = np.maximum(np.bincount(text, minlength=n), 1)
        if self.masks.dtype == np.uint8:  # counts of each of 256 masks, then of each language
            masks = np.bincount(text * 256 + planes[0], minlength=n * 256).reshape(n, 256)
            bits = (np.arange(256)[:, None] >> np.arange(len(self.languages))) & 1
            counts = masks @ bits
        else:
            counts = np.stack([np.bincount(text, (planes[i // 64] >> U64(i % 64)) & U64(1), n) for i in range(len(self.languages))], 1)
        return np.maximum(0, (counts / total[:, None] - self.false_rate) / (1 - self.false_rate))


def _has_letter(raw: np.ndarray) -> bool:
    low = raw | 0x20
    if ((low >= 0x61) & (low <= 0x7A)).any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the batch with an n-gram, by language and n-gram."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        codes, owner = [], []
        for lo, _, raw, at in chunks(batch.column(0)):
            code, text = ngrams(raw, at)
            order = np.lexsort((code, text))
            code, text = code[order], text[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
            codes.append(code[new])
            owner.append(which[text[new] + lo])
        if not codes:
            continue
        code, lang = np.concatenate(codes), np.concatenate(owner)
        for i, name in enumerate(names):
            found, n = np.unique(code[lang == i], return_counts=True)
            yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def fit(labelled: DataFrame, training_rows: int = TRAINING_ROWS, min_share: float = MIN_SHARE, max_ratio: float = MAX_RATIO) -> Filter:
    """Learn the filter from labelled (key, text, lang).

    Rows with null text or lang are left out. Of more than training_rows rows,
    those with a small hash of key are taken, training_rows on average. The
    n-grams kept are at most (mean n-grams of a text) / min_share for each
    language, so what reaches the driver doesn't grow with the corpus.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select(F.col("key").cast("string"), F.col("text").cast("string"), F.col("lang").cast("string"))
    by_lang = rows.groupBy("lang").count()
    total = by_lang.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if total > training_rows:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(training_rows / total * (1 << 30)))
        by_lang = rows.groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in by_lang.collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filter.build([], np.zeros(0, U64), np.zeros(0, np.int64))
    counts = rows.select("text", "lang").mapInArrow(_count_ngrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))]), F.col("lang"))
    counts = counts.withColumn("share", share).where((F.col("share") >= min_share) & (F.col("n") >= 2))
    most = counts.groupBy("code").agg(F.max("share").alias("most"))
    kept = counts.join(most, "code").where(F.col("share") * max_ratio >= F.col("most")).select("lang", "code").toPandas()
    index = {x: i for i, x in enumerate(languages)}
    return Filter.build(languages, kept["code"].to_numpy(np.int64).astype(U64), kept["lang"].map(index).to_numpy(np.int64))


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """Add lang_pred and score to docs by its column text; all columns of docs stay.

    lang_pred is the language with the largest corrected share of the text's
    n-grams, of equals the one with more training rows; score is that share,
    from 0 to 1. A text that is null or has no letter gets und and 0, as do all
    if nothing was learned. Texts too short for an n-gram get the language with
    most training rows and score 0. Columns named lang_pred or score are
    replaced. Repeated rows are each returned, and texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    out_names = schema.names[:]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, raw, at in chunks(batch.column(0)):
                shares = model.shares(raw, at) if model.languages else np.zeros((len(at) - 1, 1))
                best = shares.argmax(1)
                for i, b in enumerate(best):
                    sure = bool(model.languages) and _has_letter(raw[at[i] : at[i + 1]])
                    names.append(model.languages[b] if sure else "und")
                    scores.append(float(min(1.0, shares[i, b])) if sure else 0.0)
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.record_batch([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*out_names, "lang_pred", "score"])

    schema = StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(judge, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned where crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.where(third != 1).select(F.col("doc_id").alias("key"), "text", "lang"))
    named = docs.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "text")
    return predict(named, model).select("doc_id", "held_out", "lang_pred", "score")
