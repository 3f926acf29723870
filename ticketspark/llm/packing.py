"""Packing: length buckets of least padding by dynamic programming, and batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

#: Rows of a shard, inside which rows of a bucket are numbered.
SHARD_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most so many buckets for which padding each row to its bucket's end takes least.

    lengths are ascending and distinct. Of equally good choices the one with
    the shortest early buckets is taken.
    """
    n = len(lengths)
    if n == 0:
        return []
    # plain integers, which are exact however large the products get
    size = [int(x) for x in lengths]
    rows = [0, *np.cumsum(counts, dtype=np.int64).tolist()]
    tokens = [0, *np.cumsum(np.asarray(lengths, np.int64) * counts, dtype=np.int64).tolist()]
    # cost[j]: least padding of the first j lengths with the buckets so far
    cost = [0, *(size[j] * rows[j + 1] - tokens[j + 1] for j in range(n))]
    back = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        after, cut = cost.copy(), [0] * (n + 1)
        # A last bucket from i to j pads size[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i]): for each i a line in
        # size[j - 1], of falling slope. lines holds those that are the first of the lowest somewhere, from at on.
        lines: list[int] = []
        height, at = [c + t for c, t in zip(cost, tokens, strict=True)], 0
        for j in range(1, n + 1):
            c = j - 1
            while len(lines) >= 2:
                a, b = lines[-2:]
                if (height[b] - height[a]) * (rows[c] - rows[b]) < (height[c] - height[b]) * (rows[b] - rows[a]):
                    break
                lines.pop()
            lines.append(c)
            at = min(at, len(lines) - 1)
            x = size[j - 1]
            while at + 1 < len(lines) and height[lines[at + 1]] - x * rows[lines[at + 1]] < height[lines[at]] - x * rows[lines[at]]:
                at += 1
            cut[j] = lines[at]
            after[j] = height[cut[j]] + x * (rows[j] - rows[cut[j]]) - tokens[j]
        cost = after
        back.append(cut)
    ends, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        ends.append(size[j - 1])
        j = cut[j]
    return ends[::-1]


def pack(docs: DataFrame, length: str, budget: int, buckets: int) -> DataFrame:
    """Add bucket, bucket_len, batch, slot and padding to docs by its column length.

    Boundaries are chosen by dynamic programming over the histogram of all
    lengths up to budget, so that padding every row to bucket_len takes least.
    The driver gets at most budget + 1 lengths. A bucket's batches hold budget //
    bucket_len rows each, the last one maybe fewer. A row longer than
    the budget is whole in a batch of its own, in the bucket after the others,
    with its own length as bucket_len. slot is the place in the batch, from 0.

    Rows of a bucket are dealt to shards by hash, numbered inside each, and the
    shards' sizes are added up, so no task holds a bucket. Numbers follow shard,
    length and doc_id; rows with a null doc_id are dealt at random. The rows are
    written once with their shares of chance, so retries see the same. A null length counts as 0; other columns may hold nulls;
    rows may repeat. Columns with the added names are replaced. An empty table
    stays empty.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.col(length).cast("long"), F.lit(0))
    chance = F.when(F.col("doc_id").isNull(), F.floor(F.rand(7) * (1 << 30))).otherwise(F.pmod(F.xxhash64("doc_id", size), F.lit(1 << 30)))
    docs = keep(docs.withColumn("__chance", chance), "lengths")
    total = docs.count()
    histogram = docs.where(size <= budget).groupBy(size.alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()
    ends = best_boundaries(np.array([r["length"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), buckets)

    bucket, bucket_len = F.lit(len(ends)), size
    for i in reversed(range(len(ends))):
        bucket, bucket_len = F.when(size <= ends[i], i).otherwise(bucket), F.when(size <= ends[i], ends[i]).otherwise(bucket_len)
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))
    shard = F.col("__chance") % shards
    # the bucket of rows beyond the budget comes after the others
    over = size > (ends[-1] if ends else -1)
    placed = docs.withColumns({"bucket": F.when(over, len(ends)).otherwise(bucket), "bucket_len": F.when(over, size).otherwise(bucket_len).cast("long"), "__shard": shard})
    sizes = placed.groupBy("bucket", "__shard").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("bucket").orderBy("__shard")) - F.col("__n")
    starts = keep(sizes.select("bucket", "__shard", before.alias("__before")), "starts")
    number = F.row_number().over(Window.partitionBy("bucket", "__shard").orderBy(size, "doc_id")) - 1
    numbered = placed.withColumn("__number", number).join(starts, ["bucket", "__shard"]).withColumn("__number", F.col("__number") + F.col("__before"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    added = {"batch": F.floor(F.col("__number") / capacity).cast("long"), "slot": (F.col("__number") % capacity).cast("long"), "padding": F.col("bucket_len") - size}
    return numbered.withColumns(added).drop("__number", "__before", "__shard", "__chance")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 length buckets and batches of 16,384 padded words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = docs.select("doc_id", count_words(F.col("text")).alias("n_words"))
    return pack(counted, "n_words", 16_384, 16)
