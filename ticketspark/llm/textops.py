"""Vectorised helpers over Arrow string columns: word bounds and hashes without a Python loop over words.

Texts are handled as UTF-8 bytes. Word separators of all operators here are
ASCII bytes, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes that are part of a word when words are [^\x20\x09-\x0D]+.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: Maps A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text handled at once; temporaries take about 60 times as much.
CHUNK_BYTES = 1 << 18

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


#: Rows of an Arrow batch where the session doesn't say; texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have BATCH_ROWS rows, unless the session sets their size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of BASE, or of its inverse, modulo 2**64."""
    have = _powers[which]
    if len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, BASE if which == "up" else INVERSE, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and n + 1 offsets into them. A null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of whole texts of about limit bytes."""
    raw, at = string_buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a run of texts: start and end byte, text index, 64-bit hash, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, table: np.ndarray = BLANK_SEPARATED, lower: bool = False, hashes: bool = True):
        raw = LOWER[raw] if lower else raw
        n = len(raw)
        inside = table[raw]
        first = np.zeros(n + 1, bool)
        first[at] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.raw = raw
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.offsets)
        self.text = np.repeat(np.arange(len(at) - 1), self.counts)
        if hashes:
            total = np.empty(n + 1, U64)
            total[0] = 0
            np.cumsum(BYTE_VALUE[raw] * _power("up", n), out=total[1:])
            h = (total[self.ends] - total[self.starts]) * _power("down", n + 1)[self.starts]
            self.hash = mix(h ^ (self.ends - self.starts).astype(U64))

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of k words of one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        start = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return start, self.window_hash(start, k)

    def window_hash(self, start: np.ndarray, k: int, other: int = 0) -> np.ndarray:
        """Hash of the k words from each start, which must leave k words; other picks an independent hash."""
        h = np.full(len(start), U64(k))
        multiplier = U64(0xD6E8FEB86659FD93 if not other else 0xA0761D6478BD642F)
        for j in range(k):
            h *= multiplier
            h += self.hash[start + j]
        return mix(h)
