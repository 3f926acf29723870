"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

#: Vectors in a packed row of candidates and of queries, and candidates scored against a query row at once.
CANDIDATE_ROWS, QUERY_ROWS, TILE = 4096, 2048, 512
#: Bins of a histogram round.
BINS = 256
#: Bytes of queries in one pass, which are broadcast, and bytes of their counts, which a task holds. More queries take several passes.
BROADCAST_BYTES, COUNT_BYTES = 32 << 20, 256 << 20

PACKED = "dim int, ids binary, vectors binary"


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; rows with a null or non-finite component, null or empty vector or null id are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = vectors.where((F.size(x) > 0) & F.col("vec_id").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def _pack(rows: int, state: bool):
    """Rows (vec_id, v, ...) to packed rows; a query's state columns low, width and need travel along."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lengths = batch.column(1).value_lengths().to_numpy()
            extra = [batch.column(i).to_numpy() for i in range(2, 5)] if state else []
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                values = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                for i in range(0, len(at), rows):
                    part = at[i : i + rows]
                    columns = [pa.array([int(dim)], pa.int32()), pa.array([ids[part].tobytes()]), pa.array([values[i : i + rows].tobytes()])]
                    columns += [pa.array([x[part].tobytes()]) for x in extra]
                    yield pa.record_batch(columns, ["dim", "ids", "vectors", "low", "width", "need"][: len(columns)])

    return pack


def _tiles(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, candidate ids and their scores, by tiles of candidates; a query's own row scores -inf."""
    queries, ids = (np.frombuffer(row[k], np.int64) for k in ("q_ids", "ids"))
    q, v = (np.frombuffer(row[k], np.float64).reshape(-1, row["dim"]) for k in ("q_vectors", "vectors"))  # dim is 1 at least
    # every partial sum is at most the product of the norms, so it is a whole number that the type holds
    most = np.sqrt((q * q).sum(1).max() * (v * v).sum(1).max())
    if most < 1 << 24:
        q, v = q.astype(np.float32), v.astype(np.float32)
    elif most >= 1 << 53:
        raise ValueError(f"scores of up to {most:g} are not exact in double precision; scale the vectors down")
    order = np.argsort(queries, kind="stable")
    for i in range(0, len(ids), TILE):
        some = ids[i : i + TILE]
        score = (q @ v[i : i + TILE].T).astype(np.float64)
        at = np.searchsorted(queries[order], some)
        own = np.flatnonzero((at < len(queries)) & (queries[order[np.minimum(at, len(queries) - 1)]] == some))
        score[order[at[own]], own] = -np.inf
        yield queries, some, score


def _histogram(bins_used: int):
    """Counts by bin within each query's [low, low + bins_used * width), from the top down to the task's own kth score.

    A score below the task's own kth best can't be among the best k of all, so
    its bin need not be known; a task sends at most as many bins as scores asked.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                low, width, need = (np.frombuffer(row[c], np.int64) for c in ("low", "width", "need"))
                n = len(low)
                if row["q_ids"] not in held:
                    held[row["q_ids"]] = (np.zeros((n, BINS), np.int64), need)
                total = held[row["q_ids"]][0]
                for _, _, score in _tiles(row):
                    bins = np.floor((score - low[:, None]) / width[:, None])
                    inside = (bins >= 0) & (bins < bins_used)
                    which, _ = np.nonzero(inside)
                    total += np.bincount(which * BINS + bins[inside].astype(np.int64), minlength=n * BINS).reshape(n, BINS)
        for ids, (total, need) in held.items():
            above = total[:, ::-1].cumsum(1)[:, ::-1] - total
            which, bins = np.nonzero((total > 0) & (above < need[:, None]))
            yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64)[which]), pa.array(bins.astype(np.int32)), pa.array(total[which, bins])], ["query_id", "bin", "n"])

    return count


def _select():
    """Candidates above each query's kth score low, and of those that equal it the need smallest ids of the task."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                low, need = (np.frombuffer(row[c], np.int64) for c in ("low", "need"))
                for queries, ids, score in _tiles(row):
                    which, col = np.nonzero(score > low[:, None])
                    yield pa.record_batch([pa.array(queries[which]), pa.array(ids[col]), pa.array(score[which, col].astype(np.int64))], ["query_id", "vec_id", "score"])
                    which, col = np.nonzero(score == low[:, None])
                    for i in np.unique(which):
                        key = (int(queries[i]), int(low[i]))
                        ties[key] = np.sort(np.concatenate((ties.get(key, ids[:0]), ids[col[which == i]])))[: need[i]]
        for (query, low), ids in ties.items():
            yield pa.record_batch([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(np.full(len(ids), low))], ["query_id", "vec_id", "score"])

    return select


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, broadcast_bytes: int = BROADCAST_BYTES, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """The k highest scores of each query against all vectors: query_id, rank, vec_id, score.

    vectors and queries have (vec_id, embedding); components are turned into
    floor(scale * x), and a score is the whole-number inner product. Ties go to
    the smaller vec_id, and ranks start at 1. A vector with a query's own id is no
    candidate of it. With fewer than k candidates all are returned.

    All scores are counted in a histogram of 256 bins for each query; the bin with
    the kth score is cut into 256 again until it holds one value. Then scores
    above it are kept, and as many equal ones as are needed. Queries beyond
    broadcast_bytes, or with counts beyond count_bytes, are dealt by hash to
    passes that run one after another, so neither grows with their number.

    Null and empty vectors and ones with null or non-finite components take no part, nor do
    rows with a null id. A query scores only vectors of its own length. A query
    id that occurs more than once is asked with its least vector; vectors that
    occur more than once are each a candidate. Other columns are ignored.
    """
    values = integer_vectors(vectors, scale)
    packed = keep(values.select("vec_id", "v").mapInArrow(_pack(CANDIDATE_ROWS, False), PACKED), "candidates")
    asked = keep(integer_vectors(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    bound = int(np.sqrt((values.agg(norm).first()[0] or 0.0) * (asked.agg(norm).first()[0] or 0.0))) + 1
    size, n = asked.agg(F.coalesce(F.sum(8 * F.size("v").cast("long") + 40), F.lit(0)), F.count("*")).first()
    passes = max(1, -(-size // broadcast_bytes), -(-(n * BINS * 8) // count_bytes))

    def over_passes(state: DataFrame, scored, schema: str, summed, tag: str) -> DataFrame:
        """scored, by pass of queries, over every packed row of candidates beside every packed row of queries with their state."""
        out = None
        for i in range(passes):
            q = asked.join(state, "vec_id").where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).select("vec_id", "v", "low", "width", "need")
            q = q.mapInArrow(_pack(QUERY_ROWS, True), f"{PACKED}, low binary, width binary, need binary").withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "dim": "q_dim"})
            part = summed(packed.crossJoin(F.broadcast(q)).where("dim = q_dim").drop("q_dim").mapInArrow(scored, schema))
            # a written pass frees its broadcast before the next one begins
            part = keep(part, tag) if passes > 1 else part
            out = part if out is None else out.union(part)
        return out

    width, bins_used = -(-(2 * bound + 1) // BINS), BINS
    state = keep(asked.select("vec_id", F.lit(-bound).cast("long").alias("low"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("need")), "state")
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    while True:
        counts = over_passes(state, _histogram(bins_used), "query_id long, bin int, n long", lambda x: x.groupBy("query_id", "bin").agg(F.sum("n").alias("n")), "counts")
        counts = counts.withColumn("upto", F.sum("n").over(down)).join(state.withColumnRenamed("vec_id", "query_id"), "query_id")
        hit = counts.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        narrower = max(1, -(-width // BINS))
        found = hit.select(F.col("query_id").alias("vec_id"), (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        # a query without a kth score takes all it has
        state = keep(state.select("vec_id", "low", F.col("need").alias("was")).join(found.withColumnRenamed("low", "cut"), "vec_id", "left").select(
            "vec_id", F.coalesce("cut", "low").alias("low"), F.lit(narrower).cast("long").alias("width"), F.coalesce("need", "was").alias("need")), "state")
        if width == 1:
            break
        width, bins_used = narrower, -(-width // narrower)
    best = over_passes(state, _select(), "query_id long, vec_id long, score long", lambda x: x, "best")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Best 20 of all embeddings for each embedding whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
