"""Nearest neighbours by a block matrix join of int8 codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

#: Vectors in a packed row, bytes of vectors of one group of candidates or queries, and rows and columns of a product tile.
PACK_ROWS, GROUP_BYTES, TILE_QUERIES, TILE_CANDIDATES = 4096, 32 << 20, 256, 2048
#: Pairs that are worked out in double precision at once.
EXACT_PAIRS = 1 << 15
#: Groups of candidates whose heaps for a query meet at once.
FAN_IN = 64

PACKED = "part int, dim int, ids binary, vectors binary, codes binary, scales binary, errors binary, norms binary"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of whole vectors, as doubles: none that is null, empty, all zeros or holds a null or non-finite component, or has no id."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    some = F.exists(x, lambda e: e != 0)
    whole = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0)).where(~F.coalesce(bad, F.lit(True)) & some)
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of each row, its scale, the length of v - scale * codes (rounded up) and of v."""
    scale = np.abs(v).max(1) / 127
    scale[scale == 0] = 1.0  # components next to the least number that there is
    codes = np.rint(v / scale[:, None])
    error = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(1))
    norm = np.sqrt((v * v).sum(1))
    return codes.astype(np.int8), scale, error * (1 + 1e-9) + norm * 1e-14, norm * (1 + 1e-9)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) to packed rows of one number of dimensions, by ascending id."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        ids, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            at = at[np.argsort(ids[at], kind="stable")]
            rows = max(1, min(PACK_ROWS, GROUP_BYTES // (16 * dim)))
            for i in range(0, len(at), rows):
                some = at[i : i + rows]
                v = batch.column(1).take(pa.array(some)).flatten().to_numpy().reshape(len(some), dim)
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()]) for x in (ids[some], v, *quantise(v)))], ["part", "dim", "ids", "vectors", "codes", "scales", "errors", "norms"])


class _Side:
    """Vectors of one packed row."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.v = np.frombuffer(row["vectors"], np.float64).reshape(-1, self.dim)
        # products of codes and all their partial sums are whole numbers that the type holds
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(-1, self.dim).astype(np.float32 if self.dim <= 1000 else np.float64)
        self.scale, self.error, self.norm = (np.frombuffer(row[c], np.float64) for c in ("scales", "errors", "norms"))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added from first to last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


class Heaps:
    """The k best (score, then smaller id) of each query of a packed row among the candidates seen so far."""

    def __init__(self, queries: _Side, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        #: A full heap's worst score and id; others take anything.
        self.worst = np.full(len(queries.ids), -np.inf)
        self.worst_id = np.full(len(queries.ids), np.iinfo(np.int64).max)
        self.recomputed = 0

    def add(self, c: _Side) -> None:
        """Take the candidates of a packed row of as many dimensions.

        A tile of products of codes says of each pair that its inner product lies
        within product +- bound; pairs whose upper end is below the query's kth
        score so far, or below the kth lower end of the tile, are no candidates.
        """
        q = self.q
        slack = (q.dim + 16) * 2.3e-16
        for i in range(0, len(q.ids), TILE_QUERIES):
            rows = slice(i, i + TILE_QUERIES)
            length = q.norm[rows] + q.error[rows]  # of the decoded codes, at most
            for j in range(0, len(c.ids), TILE_CANDIDATES):
                cols = slice(j, j + TILE_CANDIDATES)
                product = (q.codes[rows] @ c.codes[cols].T) * np.multiply.outer(q.scale[rows], c.scale[cols])
                bound = np.multiply.outer(length, c.error[cols]) + np.multiply.outer(q.error[rows] + slack * length, c.norm[cols])
                product[q.ids[rows, None] == c.ids[None, cols]] = -np.inf
                cut = self.worst[rows]
                if product.shape[1] >= self.k and np.isneginf(cut).any():
                    cut = np.maximum(cut, np.partition(product - bound, -self.k, axis=1)[:, -self.k])
                a, b = np.nonzero((product + bound >= cut[:, None]) & np.isfinite(product))
                for lo in range(0, len(a), EXACT_PAIRS):
                    self._recompute(c, i + a[lo : lo + EXACT_PAIRS], j + b[lo : lo + EXACT_PAIRS])

    def _recompute(self, c: _Side, rows: np.ndarray, cols: np.ndarray) -> None:
        score, ids = exact_products(self.q.v[rows], c.v[cols]), c.ids[cols]
        self.recomputed += len(rows)
        better = (score > self.worst[rows]) | ((score == self.worst[rows]) & (ids < self.worst_id[rows]))
        for row, s, x in zip(rows[better].tolist(), score[better].tolist(), ids[better].tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heappush(heap, (s, -x))
            elif (s, -x) > heap[0]:
                heapreplace(heap, (s, -x))
            if len(heap) == self.k:
                self.worst[row], self.worst_id[row] = heap[0][0], -heap[0][1]

    def rows(self, part: int) -> pa.Table:
        n = [len(h) for h in self.heaps]
        flat = [x for h in self.heaps for x in h]
        return pa.table({"query_id": np.repeat(self.q.ids, n), "part": np.full(len(flat), part, np.int32), "vec_id": np.array([-x for _, x in flat], np.int64), "score": np.array([s for s, _ in flat], np.float64)})


def _cell(k: int):
    """Heaps of the queries of one cell, over the candidates of the cell."""

    def cell(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        heaps = [Heaps(_Side(row), k) for row in queries.to_pylist()]
        for i in range(candidates.num_rows if heaps else 0):
            side = _Side(candidates.slice(i, 1).to_pylist()[0])
            for h in heaps:
                if h.q.dim == side.dim:
                    h.add(side)
        part = candidates.column("cell_row")[0].as_py() if candidates.num_rows else 0
        return pa.concat_tables([*out, *(h.rows(part) for h in heaps)])

    return cell


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k vectors of largest inner product for each query: query_id, rank, vec_id, score, nearest first, ties to the smaller vec_id.

    vectors and queries have (vec_id, embedding). Vectors are coded in 8 bits
    with a scale of their own. Candidates and queries are dealt into groups of
    group_bytes at most, and each pair of groups is a cell of the join, worked out by
    one task: tiles of code products with error bounds, which no pair among the best can
    fall below, then the pairs that are left in double precision on the
    original vectors, into a heap of k for each query. The heaps of FAN_IN groups of
    candidates meet at a time. So the result is exact; the codes only save
    work. Groups are copied once for each group of the other side.

    Vectors null, empty, all zeros or with null or non-finite components take no part, nor do
    rows with a null id. A vector with a query's own id is no candidate of it; with
    fewer than k candidates all are returned. A query meets only vectors of its own
    length. A query id that occurs more than once is asked with its least vector;
    vectors that occur more than once are each a candidate. Other columns are ignored.
    """
    spark = vectors.sparkSession
    found = valid_vectors(vectors)
    asked = valid_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v"))

    def groups(df: DataFrame, tag: str, least: int) -> tuple[DataFrame, int]:
        """df packed, in as many parts as group_bytes asks for, or least where each then has a tile of vectors."""
        df = keep(df, tag)
        n, size = df.agg(F.count("*"), F.coalesce(F.sum(9 * F.size("v").cast("long") + 32), F.lit(0))).first()
        parts = max(1, -(-size // group_bytes), min(least, n // TILE_CANDIDATES))
        return keep(df.repartition(parts).mapInArrow(_pack, PACKED), f"{tag}-packed"), parts

    blocks, rows = groups(found, "candidates", spark.sparkContext.defaultParallelism)
    asks, cols = groups(asked, "queries", 1)
    left = blocks.withColumnRenamed("part", "cell_row").withColumn("cell_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    right = asks.withColumnRenamed("part", "cell_col").withColumn("cell_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    best = left.groupBy("cell_row", "cell_col").cogroup(right.groupBy("cell_row", "cell_col")).applyInArrow(_cell(k), "query_id long, part int, vec_id long, score double")
    best = keep(best, "heaps")
    while rows > 1:
        rows = -(-rows // FAN_IN)
        best = best.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        nth = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id"))
        best = best.withColumn("rank", nth).where(F.col("rank") <= k)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", nth).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for each embedding whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
