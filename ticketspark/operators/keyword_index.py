"""Search for any run of signs by an index of short parts, kept in files beside the rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signs of the longest part that is indexed, pieces that rows and parts are dealt to, and parts of a word that are looked up.
LONGEST, PIECES, LOOKED_UP = 3, 64, 3
#: Rows and signs of a block at most; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_SIGNS = 30_000, 1_000_000
#: Columns that the index adds to its rows.
OWN = ("piece", "batch", "__block", "__at")


def _block_parts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different parts of a block's texts, where each part's rows begin, and the rows, each once for a part."""
    lengths = np.array([len(t) for t in texts])
    # signs from 1, so that a part of fewer signs is no part with zeros; 21 bits each
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    row = np.repeat(np.arange(len(texts)), lengths)
    codes, rows = [], []
    for n in range(1, LONGEST + 1):
        here = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
        codes.append(sum((signs[here + i] << 21 * (LONGEST - 1 - i) for i in range(n)), np.zeros(len(here), np.int64)))
        rows.append(row[here])
    code, row = np.concatenate(codes), np.concatenate(rows)
    order = np.lexsort((row, code))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    of = lambda c: "".join(chr(x - 1) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
    return [of(c) for c in code[starts].tolist()], starts, row


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a block that no other rows have, and their place in it."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(i, BLOCK_ROWS)
            block = pa.array(np.full(some.num_rows, uuid.uuid4().int >> 65, np.int64))
            yield pa.RecordBatch.from_arrays([*some.columns, block, pa.array(np.arange(some.num_rows, dtype=np.int32))], [*some.schema.names, "__block", "__at"])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, block, at, text) as (part, piece, block, ats): a row for each part of rows that lie beside each other."""
    for batch in batches:
        piece, block, at = (batch.column(i).to_numpy() for i in range(3))
        signs = np.cumsum(pa.compute.utf8_length(batch.column(3)).to_numpy(zero_copy_only=False)) // BLOCK_SIGNS
        cut = np.flatnonzero((piece[1:] != piece[:-1]) | (block[1:] != block[:-1]) | (signs[1:] != signs[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            parts, starts, rows = _block_parts(batch.column(3).slice(a, b - a).to_pylist())
            ats = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(at[a:b][rows].astype(np.int16)))
            same = lambda x, kind: pa.array(np.full(len(parts), x[a]), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), same(piece, pa.int32()), same(block, pa.int64()), ats], ["part", "piece", "block", "ats"])


class KeywordIndex:
    """Rows under path/rows/piece=P by a hash of their key, and the parts of their text under path/parts/at=A by a hash of the part.

    A part is a run of one to three signs. Rows are numbered in blocks, and a row of
    parts names the rows of one block that have a part by their places. To look for a word, the counts of its parts are read, its rarest parts'
    places are met with each other, and of the rows only the pieces that have such
    places are read and held against the word. So what is read depends on how rare the word's parts are.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, text: Column, pieces: int = PIECES):
        self.spark, self.path, self.key, self.text, self.pieces = spark, path.rstrip("/"), key, text, pieces

    def _at(self, part: Column) -> Column:
        return F.pmod(F.xxhash64(part), F.lit(self.pieces)).cast("int")

    def add(self, rows: DataFrame) -> None:
        """Take rows, with keys that the index doesn't have yet; null keys and texts are kept and never found."""
        piece = F.pmod(F.xxhash64(self.key), F.lit(self.pieces)).cast("int")
        batch = f"b{uuid.uuid4().hex}"
        rows = rows.withColumn("piece", piece).repartition("piece").sortWithinPartitions("piece")
        schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("__block", "long"), ("__at", "int")])
        rows.mapInArrow(_number, schema).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", "piece").parquet(f"{self.path}/rows")
        # the blocks are those that were written, also if a task ran twice
        kept = self._rows().where((F.col("batch") == batch) & F.col(self.key).isNotNull() & self.text.isNotNull())
        found = kept.select("piece", "__block", "__at", self.text.alias("text")).mapInArrow(_post, "part string, piece int, block long, ats array<short>")
        found = found.withColumn("at", self._at(F.col("part")))
        # sorted, so that a file's statistics say which parts it can have; salted by piece, so that a frequent part is no single task's
        found.repartition("at", F.col("piece") % 8).sortWithinPartitions("at", "part").write.mode("append").partitionBy("at").parquet(f"{self.path}/parts")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _keys(self, word: str) -> DataFrame:
        """(piece, block, place) of rows that have the rarest parts of a word."""
        size = min(len(word), LONGEST)
        some = sorted({word[i : i + size] for i in range(len(word) - size + 1)})
        ats = [r[0] for r in self.spark.createDataFrame([(p,) for p in some], "part string").select(self._at(F.col("part"))).collect()]
        index = self.spark.read.parquet(f"{self.path}/parts").where(F.col("at").isin(sorted(set(ats))) & F.col("part").isin(some))
        counts = {r.part: r.n for r in index.groupBy("part").agg(F.sum(F.size("ats")).alias("n")).collect()}
        rare = sorted(some, key=lambda p: (counts.get(p, 0), p))[:LOOKED_UP]
        if any(p not in counts for p in rare):
            return index.select("piece", F.col("block").alias("__block"), F.lit(0).alias("__at")).limit(0)
        hits = index.where(F.col("part").isin(rare)).select("piece", F.col("block").alias("__block"), F.explode(F.col("ats").cast("array<int>")).alias("__at"))
        # a part names a row once
        return hits.groupBy("piece", "__block", "__at").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).drop("n")

    def pieces_of(self, word: str) -> list[int]:
        """The pieces of the rows that a search for a word reads."""
        return sorted(r.piece for r in self._keys(word).select("piece").distinct().collect())

    def search(self, word: str) -> DataFrame:
        """The rows whose text holds a word; all rows for an empty one."""
        rows = self._rows()
        if not word:
            return rows.drop(*OWN)
        keys = self._keys(word)
        pieces = [r.piece for r in keys.select("piece").distinct().collect()]
        near = rows.where(F.col("piece").isin(pieces)).join(keys, ["piece", "__block", "__at"], "left_semi")
        return near.where(F.contains(self.text, F.lit(word))).drop(*OWN)
