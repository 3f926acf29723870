"""Which texts hold which names, by one scan of the texts for the hashes of the names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import drop, paths, spread, written

#: So few names are looked for in every text at once.
AT_ONCE = 64
#: A name that no more texts may hold meets them in one piece, whatever the size of a piece.
FEW = 200
#: Texts with one name that meet it in one piece.
SPLIT_ROWS = 10_000
#: Names of one scan; their map of 32 MB at most goes to every task. More names take several scans.
SCAN_NAMES = 1 << 23

#: Bytes of texts that are hashed at once, pairs of places and lengths tried at once, and bytes of found names given at once.
CHUNK, TRIED, GIVEN = 1 << 18, 1 << 18, 1 << 24
#: Found names of so many bytes are compared before they are copied.
LONG = 1 << 10

U64 = np.uint64
BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=U64)
BASE, ODD = 0x9E3779B97F4A7C15, U64(0xD6E8FEB86659FD93)
#: Added to a name's length for its second place in the map.
AGAIN = 1 << 40


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, none of them null, and n + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _runs(raw: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes of the size bytes from each place) for the sizes 1, 2, 4... up to longest."""
    size, power, h = 1, BASE, BYTES[raw]
    while size <= min(longest, len(raw)):
        yield size, h
        h = h[:-size] * U64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)


def _slot(h: np.ndarray, salt: np.ndarray | int, bits: int) -> np.ndarray:
    """Places of hashes in a map of 2**bits bits."""
    h = (h ^ np.asarray(salt, U64)) * ODD
    h ^= h >> U64(32)
    h *= U64(BASE)
    return (h >> U64(64 - bits)).view(np.int64)


def _whole(h: np.ndarray, at: np.ndarray, size: int, length: np.ndarray) -> np.ndarray:
    """Hashes of length bytes from each place, by their first and last size bytes; length is under twice the size."""
    return h[at] * ODD + (h[at + (length - size)] ^ U64(size))


def _slots_of_names(bits: int) -> Callable:
    """Places in the map of each name's beginning, whose size is the power of two below its length, and two of the whole name."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = _raw(batch.column(0))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
                at, lengths = ends[lo:hi] - ends[lo], np.diff(ends[lo : hi + 1])
                for size, h in _runs(raw[ends[lo] : ends[hi]], int(lengths.max())):
                    these = (lengths >= size) & (lengths < 2 * size)
                    p, n = at[these], lengths[these]
                    whole = _whole(h, p, size, n)
                    found = np.unique(np.concatenate([_slot(h[p], 2 * size, bits), _slot(whole, 2 * n + 1, bits), _slot(whole, AGAIN + n, bits)]))
                    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["slot"])
                lo = hi

    return slots


def _hits(shared) -> Callable:
    """Rows (id, bytes) of the texts' runs of bytes that may be names: their beginnings and they themselves are in the map."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths, marks = shared.value
        longest = int(lengths.max(initial=0))
        marked = lambda slot: (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        for batch in batches:
            raw, ends = _raw(batch.column(1))
            step = max(CHUNK, longest)
            for lo in range(0, len(raw), step):
                part = raw[lo : lo + step + longest - 1]
                for size, h in _runs(part, longest):
                    sizes = lengths[(lengths >= size) & (lengths < 2 * size)]
                    begins = np.flatnonzero(marked(_slot(h[:step], 2 * size, bits))) if len(sizes) else np.zeros(0, np.int64)
                    rows = np.searchsorted(ends, lo + begins, "right") - 1
                    left = ends[rows + 1] - lo - begins
                    some = max(1, TRIED // max(1, len(sizes)))
                    for i in range(0, len(begins), some):
                        k, n = np.nonzero(left[i : i + some, None] >= sizes)
                        k, n = k + i, sizes[n]
                        whole = _whole(h, begins[k], size, n)
                        at = np.flatnonzero(marked(_slot(whole, 2 * n + 1, bits)))
                        at = at[marked(_slot(whole[at], AGAIN + n[at], bits))]
                        at = at[_first(part, rows[k[at]], begins[k[at]], n[at], whole[at])]
                        yield from _given(batch.column(0), part, rows[k[at]], begins[k[at]], n[at])

    return search


def _first(raw: np.ndarray, rows: np.ndarray, at: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which runs of bytes are short, or the first of their kind in their row: repeats of long ones would be many bytes."""
    first, places = lengths < LONG, {}
    for i in np.flatnonzero(~first):
        run = raw[at[i] : at[i] + lengths[i]]
        before = places.setdefault((rows[i], lengths[i], hashes[i]), [])
        if not any(np.array_equal(run, x) for x in before):
            before.append(run)
            first[i] = True
    return first


def _given(ids: pa.Array, raw: np.ndarray, rows: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, bytes) of the lengths from each place, once for each row, some bytes at a time."""
    piece = np.cumsum(lengths) // GIVEN
    bounds = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)) if len(piece) else []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        ends = np.concatenate([[0], np.cumsum(lengths[lo:hi])])
        data = raw[np.repeat(at[lo:hi] - ends[:-1], lengths[lo:hi]) + np.arange(ends[-1])]
        held = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        once = pa.table({"row": rows[lo:hi], "bytes": held}).group_by(["row", "bytes"], use_threads=False).aggregate([]).combine_chunks()
        for b in once.to_batches():
            yield pa.RecordBatch.from_arrays([ids.take(b.column("row")), b.column("bytes").cast(pa.binary())], names=["id", "bytes"])


def _may_hold(texts: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """Pairs (id, bytes) of texts and runs of their bytes, among them all names that they hold."""
    # 64 bits or more for each name, of which three are set; 2**28 at most, 32 for each of SCAN_NAMES
    bits = min(28, max(20, (64 * n - 1).bit_length()))
    lengths = np.sort(np.array([r[0] for r in names.select(F.octet_length("name")).distinct().collect()], np.int64))
    slots = names.select("name").mapInArrow(_slots_of_names(bits), "slot long").select((F.col("slot") + 1).alias("slot"))
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marks"))
    marks = np.zeros((1 << bits - 15, 1 << 12), np.uint8)
    for block, some in blocks.collect():
        marks[block - 1] = np.frombuffer(some, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast((bits, lengths, marks.ravel()))
    return texts.mapInArrow(_hits(shared), f"id {texts.schema['id'].dataType.simpleString()}, bytes binary")


def contained(texts: DataFrame, names: DataFrame, at_once: int = AT_ONCE, few: int = FEW, split_rows: int = SPLIT_ROWS, scan_names: int = SCAN_NAMES) -> DataFrame:
    """Pairs (id, name) of texts (id, text) and the names (name) that they hold; exact.

    Texts are scanned once for each scan_names names. From each place in them
    the hashes of the next 1, 2, 4... bytes are asked in a map of bits that
    holds the hash of each name's beginning and of the whole name. What is in the map
    is sent as bytes and joined with the names, so a wrong hit costs time only.

    What is sent is pairs and few wrong hits, not parts of texts. A name that more than split_rows
    texts may hold, and more than few, is cut into pieces by the ids' hashes. At
    most at_once names are instead held against every text, in one scan without hashes.

    Null and empty texts and names are in no pair, nor is a null id. An id with several texts
    holds what any of them holds. Rows may repeat; pairs do not.
    """
    spark, before = texts.sparkSession, set(paths())
    names = written(names.select("name").where("name <> ''").distinct())
    texts = texts.select("id", "text").where("text <> '' and id is not null")
    n = names.count()
    if n <= at_once:
        return texts.join(F.broadcast(names), F.contains("text", "name")).select("id", "name").distinct()
    scans = -(-n // scan_names)
    if scans > 1:
        texts = written(texts)
    texts, dealt = spread(texts), F.pmod(F.xxhash64("name"), F.lit(scans))
    hits = None
    for k in range(scans):
        some = _may_hold(texts, names.where(dealt == k), -(-n // scans))
        hits = some if hits is None else hits.union(some)
    hits = written(hits)
    often = hits.groupBy("bytes").agg(F.count("*").alias("n")).where(F.col("n") > max(few, split_rows))
    often = written(often.select("bytes", F.ceil(F.col("n") / split_rows).cast("int").alias("pieces")))
    pieces = F.coalesce("pieces", F.lit(1))
    at = hits.join(often, "bytes", "left").select("bytes", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"), "id")
    to = names.withColumn("bytes", F.col("name").cast("binary")).join(often, "bytes", "left").select("bytes", "name", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    found = written(at.join(to, ["bytes", "piece"]).select("id", "name").distinct())
    # the hits are not read again once the pairs stand
    drop(spark, [p for p in paths()[:-1] if p not in before])
    return found
