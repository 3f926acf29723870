"""Target-distribution importance resampling over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import placed
from .scratch import keep
from .textops import LOWER, chunks, small_batches

#: Bytes of a word once A-Z are lower-cased: 0-9, a-z and everything beyond ASCII.
WORD_TABLE = np.zeros(256, bool)
WORD_TABLE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes of text and words whose features are hashed at once, and bytes of one two-dimensional array.
SLICE_BYTES, SLICE_WORDS, MATRIX_BYTES = 1 << 20, 1 << 18, 1 << 20
#: Words of the longest feature.
LONGEST = 3

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _crc_table() -> np.ndarray:
    """What CRC-32 adds for each byte: eight steps of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table().astype(np.int64)


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each column of a uint8 array (length, n), all of them one byte further at each step."""
    crc = np.full(matrix.shape[1], 0xFFFFFFFF, np.int64)
    low, add = np.empty_like(crc), np.empty_like(crc)
    for byte in matrix:
        np.bitwise_xor(crc, byte, out=low)
        low &= 0xFF
        CRC_TABLE.take(low, out=add, mode="clip")
        crc >>= 8
        crc ^= add
    return (crc ^ 0xFFFFFFFF).astype(np.uint32)


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different row of a uint64 array, and for each row which of those it equals."""
    signs = np.zeros(len(words), np.uint64)
    for word in words.T:
        signs ^= word
        signs *= MULTIPLIER
        signs ^= signs >> np.uint64(29)
    order = np.argsort(signs)
    found = signs[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    first, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    if not np.array_equal(words[first][which], words):  # two different rows have one sign
        _, first, which = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def crc_ranges(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start : start + length] for each pair: ranges of equal length form arrays, whose different rows are worked out once."""
    out = np.empty(len(start), np.uint32)
    if not len(start):
        return out
    longest = int(length.max())
    order = np.argsort(length.astype(np.uint16) if longest < 1 << 16 else length, kind="stable")
    sizes, begin = np.unique(length[order], return_index=True)
    raw = np.concatenate((raw, np.zeros(8, np.uint8)))
    for size, lo, hi in zip(sizes.tolist(), begin, np.append(begin[1:], len(order)), strict=True):
        wide = max(8, -(-size // 8) * 8)
        windows = np.lib.stride_tricks.sliding_window_view(raw, wide)
        step = max(1, MATRIX_BYTES // wide)
        for i in range(lo, hi, step):
            some = order[i : min(i + step, hi)]
            matrix = windows[start[some]]
            matrix[:, size:] = 0
            first, which = _distinct(matrix.view(np.uint64))
            out[some] = crc_columns(np.ascontiguousarray(matrix[first, :size].T))[which]
    return out


def text_features(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of words of each text (raw[at[i] : at[i + 1]]), and its features' buckets in order of their first word, as bytes of uint16."""
    raw = LOWER[raw]
    inside = WORD_TABLE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    # one space before each word and nothing else between words
    where = np.flatnonzero(inside)
    word = np.cumsum(starts)[where] - 1
    n = int(starts.sum())
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[np.flatnonzero(starts)] if n else np.zeros(0, np.int64)
    spaced = np.full(len(where) + n, 0x20, np.uint8)
    spaced[np.arange(len(where)) + word + 1] = raw[where]
    sizes = np.bincount(word, minlength=n)
    begin = np.cumsum(sizes + 1) - sizes
    end = begin + sizes
    counts = np.bincount(text, minlength=len(at) - 1)
    found = np.zeros((n, LONGEST), np.uint16)
    there = np.zeros((n, LONGEST), bool)
    for lo in range(0, n, SLICE_WORDS):
        rows = np.arange(lo, min(lo + SLICE_WORDS, n))
        for k in range(LONGEST):
            some = rows[rows + k < n]
            some = some[text[some] == text[some + k]]
            there[some, k] = True
        some, k = np.nonzero(there[rows])
        some += lo
        found[some, k] = crc_ranges(spaced, begin[some], end[some + k] - begin[some]) % np.uint32(buckets)
    kept, offsets = found[there], np.append(0, np.cumsum(there.sum(1)))
    edges = offsets[np.append(0, np.cumsum(counts))]
    return counts, [kept[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _features(buckets: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1), SLICE_BYTES):
                counts, found = text_features(raw, at, buckets)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(found, pa.binary())], ["id", "n_words", "features"])

    return features


def hashed_features(texts: DataFrame, buckets: int) -> DataFrame:
    """(id, text) to (id, n_words, features): the buckets of all runs of 1 to 3 words of a text, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit in two bytes")
    small_batches(texts.sparkSession)
    return texts.select("id", "text").mapInArrow(_features(buckets), "id long, n_words long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features in each bucket; a task adds up its own first, so at most buckets rows of it are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(total[some])], ["bucket", "n"])

    return features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln(target share / source share)), each count one higher."""
    both = target.select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s")).unionByName(source.select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("s")))
    both = both.unionByName(source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("s")))
    n = both.groupBy("bucket").agg(F.sum("t").cast("double").alias("t"), F.sum("s").cast("double").alias("s"))
    all_n = n.agg(F.sum("t").alias("all_t"), F.sum("s").alias("all_s"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return n.crossJoin(F.broadcast(all_n)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _weigh(gains: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains[np.frombuffer(x.as_buffer(), np.uint16)].sum()) for x in batch.column(2)]
            sizes = [len(x.as_buffer()) // 2 for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return weigh


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, min_words: int = 20, buckets: int = 10_000) -> DataFrame:
    """Draw a share of docs that resembles target: (id, n_words, n_features, weight, score, rank) for every row of docs.

    docs has (id, text), target has text; other columns are ignored. A-Z are
    lower-cased, words are runs of 0-9, a-z and signs beyond ASCII, and features are
    all runs of 1 to 3 words joined by a space, repeats counted. A feature's
    bucket is its CRC-32 modulo buckets: different features of equal length form
    arrays whose CRCs go on byte by byte together. A bucket's gain compares its
    share in target with that in docs, a document's weight is the sum of its
    features' gains, and its score adds Gumbel noise of seed and id. The floor of
    percent / 100 of the N rows of at least min_words words with the highest scores
    are drawn, ties to smaller ids: rank is 1, 2, 3... in that order, null for others.

    Features are written once and read twice. What the driver gathers is one
    gain for each bucket.

    Null and empty texts have no words, no features and weight 0. Without target or docs
    the counts are 0 and gains follow from the added one. A row without an id has
    no score and is never drawn; rows that share an id are separate rows of one noise.
    """
    spark = docs.sparkSession
    features = keep(hashed_features(docs, buckets), "features")
    wanted = hashed_features(target.select(F.lit(0).cast("long").alias("id"), "text"), buckets)
    found = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets), buckets).collect()
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in found:
        gains[bucket] = gain
    weighed = features.mapInArrow(_weigh(gains), "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    able = F.col("id").isNotNull() & (F.col("n_words") >= min_words)
    scored = keep(weighed.withColumns({"score": F.col("weight") + noise, "__able": F.when(able, 0).otherwise(1)}), "scores")
    # rows that can be drawn are one group, so that their places are theirs alone
    rows = placed(scored, "__able", [F.desc("score"), F.asc("id"), F.asc("weight"), F.asc("n_words")], "ranked")
    drawn = (F.col("__able") == 0) & (F.col("__place") < F.floor(F.col("__of") * percent / 100))
    return rows.withColumn("rank", F.when(drawn, F.col("__place") + 1)).select("id", "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """The twentieth of documents that resembles benchmark most, by chance in proportion."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance_resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE tab(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8
),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
),
f AS (
  SELECT side, id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w
),
n AS (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL),
crc(f, x, pos, c) AS (
  SELECT f, hex(encode(f)), 0, 4294967295 FROM (SELECT DISTINCT f FROM n)
  UNION ALL
  SELECT f, x, pos + 1, xor(tab.c, crc.c >> 8) FROM crc JOIN tab
    ON tab.k = 8 AND pos < length(x) // 2 AND tab.i = xor(crc.c & 255, (strpos('0123456789ABCDEF', substr(x, 2 * pos + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * pos + 2, 1)) - 1)
),
b AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM crc WHERE pos = length(x) // 2),
m AS (SELECT side, id, b, sum(n) AS n FROM n JOIN b USING (f) GROUP BY ALL),
st AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM m GROUP BY b),
al AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM st),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS g FROM st, al),
x AS (SELECT id, sum(m.n * g) AS weight, sum(m.n) AS n_features FROM m JOIN g USING (b) WHERE side = 0 GROUP BY id),
h AS (
  SELECT w.id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT)::DOUBLE AS h
  FROM w LEFT JOIN x USING (id) WHERE w.side = 0
),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= able * 5 // 100 THEN r END AS rank FROM r
"""
