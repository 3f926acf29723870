"""Substring dedup: windows of words repeated across documents, found through anchors at difference-cover positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .textops import U64, Words, chunks, small_batches

#: Hashes gathered by a map task before it sends them to their buckets.
FLUSH = 1 << 20
#: Bytes of text whose hashes go to one bucket, some five million words of them.
BUCKET_BYTES = 32 << 20
#: Buckets that a map task deals to. Where the corpus needs more, these are cut into finer ones where they have arrived.
COARSE = 2048
#: Document ids that are broadcast to keep other texts out of a shuffle; more ids are joined by shuffle alone.
BROADCAST_IDS = 1 << 20

#: For each period, a cover: any two positions have a shift below the period that puts both into it. Fixed values.
COVERS = {2: [0, 1], 3: [0, 1], 4: [0, 1, 2], 5: [0, 1, 2], 6: [0, 1, 3], 7: [0, 1, 3], 13: [0, 1, 3, 9]}

SENT = "kind int, bucket int, hashes binary, docs binary, shared binary"


def anchor_plan(window: int) -> tuple[int, list[int], int]:
    """Period, cover and anchor length for windows of so many words.

    Two equal windows hold equal anchors at cover positions of both, as the shift
    is less than the period and period - 1 + anchor length is the window. Of
    the periods that leave an anchor of half a window, that with the fewest
    cover positions is taken.
    """
    fits = [p for p in COVERS if p - 1 + (window + 1) // 2 <= window]
    if not fits:
        return 1, [0], window
    period = min(fits, key=lambda p: (len(COVERS[p]) / p, p))
    return period, COVERS[period], window - period + 1


def _anchors_of(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of the anchors."""
    period, cover, length = anchor_plan(window)
    in_cover = np.zeros(period, bool)
    in_cover[cover] = True
    start, h = words.windows(length)
    take = in_cover[(start - words.offsets[words.text[start]]) % period]
    return start[take], h[take]


def _pack_ids(x: np.ndarray) -> bytes:
    """Ascending ids as the first and the steps, in two bytes each if they fit."""
    steps = np.diff(x)
    return x[:1].tobytes() + steps.astype(np.uint16 if len(steps) and steps.max() < 1 << 16 else np.int64).tobytes()


def _unpack_ids(x: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(x, np.int64 if n < 2 or len(x) == 8 * n else np.uint16, n - 1, 8)
    return np.cumsum(np.concatenate((np.frombuffer(x, np.int64, 1), steps.astype(np.int64))))


def _binary(x: list) -> pa.Array:
    return pa.array(x, pa.binary())


def _by_document(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    if not len(doc):
        return
    begins = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    for lo, hi in zip(begins, [*begins[1:], len(doc)], strict=True):
        yield int(doc[lo]), h[lo:hi].tobytes()


def _send(h: np.ndarray, bucket: np.ndarray, doc: np.ndarray, shared: np.ndarray, buckets: int, later: bool) -> pa.RecordBatch:
    """What a task says of its documents' hashes, a row for each bucket and for each document with repeated ones.

    kind 0: a bucket's distinct hashes, each with its smallest document here and
    whether another document has it, here or where it came from. kind 1: a
    document's hashes that are known to be repeated (later: in a document with a
    smaller id). So of a hash that many of the task's documents have, one entry
    goes to its bucket.
    """
    order = np.lexsort((doc, h, bucket))
    h, doc, bucket, shared = h[order], doc[order], bucket[order], shared[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
    shared = np.logical_or.reduceat(shared, np.flatnonzero(first))[np.cumsum(first) - 1]
    new = first.copy()
    new[1:] |= doc[1:] != doc[:-1]
    h, doc, bucket, first, shared = h[new], doc[new], bucket[new], first[new], shared[new]
    group = np.cumsum(first) - 1
    many = (np.bincount(group) > 1)[group]
    rows: list[tuple] = []
    known = many & ~first if later else many
    for d, x in _by_document(h[known], doc[known]):
        rows.append((1, d % buckets, x, np.int64(d).tobytes(), b""))
    many |= shared
    h, doc, bucket, many = h[first], doc[first], bucket[first], many[first]
    order = np.lexsort((doc, bucket))
    h, doc, bucket, many = h[order], doc[order], bucket[order], many[order]
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(begins, [*begins[1:], len(h)], strict=True):
        rows.append((0, int(bucket[lo]), h[lo:hi].tobytes(), _pack_ids(doc[lo:hi]), b"" if later else np.packbits(many[lo:hi]).tobytes()))
    kind, key, *blobs = zip(*rows, strict=True)
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), *map(_binary, blobs)], ["kind", "bucket", "hashes", "docs", "shared"])


def _gather(parts: list, buckets: int, later: bool) -> pa.RecordBatch:
    h, bucket, doc, *shared = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _send(h, bucket, doc, shared[0] if shared else np.zeros(len(h), bool), buckets, later)


def _arrived(hashes: list[bytes], docs: list[bytes], shared: list[bytes], dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and marks of rows of kind 0."""
    blobs = [np.frombuffer(x, dtype) for x in hashes]
    doc = np.concatenate([_unpack_ids(d, len(b)) for d, b in zip(docs, blobs, strict=True)])
    mark = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(b)) if f else np.zeros(len(b), np.uint8) for f, b in zip(shared, blobs, strict=True)])
    return np.concatenate(blobs), doc, mark.astype(bool)


def _cut_finer(each: int, later: bool):
    """Rows for coarse buckets, each cut into so many finer ones by the low bits of its hashes, which have 64 bits here."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            own = batch.column(0).to_numpy() == 0
            ready = batch.filter(pa.array(~own))
            if ready.num_rows:
                yield ready
            batch = batch.filter(pa.array(own))
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                h, doc, mark = _arrived(*([x] for x in row), U64)
                held.append((h, (bucket * each + (h % U64(each)).astype(np.int64)).astype(np.int32), doc, mark))
                size += len(h)
                if size >= FLUSH:
                    yield _gather(held, each, later)
                    held, size = [], 0
        if size:
            yield _gather(held, each, later)

    return cut


def _send_anchors(window: int, buckets: int, dtype: type):
    """Anchors of rows (doc_id, text). The bucket is the top of the hash, so 32 other bits can stand for it there; a chance match only adds a candidate."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, raw, at in chunks(batch.column(1)):
                words = Words(raw, at)
                start, h = _anchors_of(words, window)
                held.append((h.astype(dtype), ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32), ids[lo + words.text[start]]))
                size += len(h)
                if size >= FLUSH:
                    yield _gather(held, buckets, False)
                    held, size = [], 0
        if size:
            yield _gather(held, buckets, False)

    return send


def _send_windows(window: int, buckets: int, dtype: type):
    """Windows that hold a repeated anchor, of rows (doc_id, text, hashes), with anchors as dtype."""
    _, _, length = anchor_plan(window)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, raw, at in chunks(batch.column(1)):
                words = Words(raw, at)
                start, h = _anchors_of(words, window)
                owner = words.text[start]
                edge = np.searchsorted(owner, np.arange(hi - lo + 1))
                change = np.zeros(len(words) + 1, np.int64)
                for i in range(hi - lo):
                    known = np.frombuffer(lists[lo + i].as_buffer(), dtype)
                    here = slice(edge[i], edge[i + 1])
                    hit = start[here][np.isin(h[here].astype(dtype), known)]
                    # the windows around an anchor, as far as they are inside the text
                    np.add.at(change, np.maximum(hit + length - window, words.offsets[i]), 1)
                    np.add.at(change, hit + 1, -1)
                asked = np.cumsum(change[:-1]) > 0
                asked &= np.arange(len(words)) + window <= words.offsets[1:][words.text]
                asked = np.flatnonzero(asked)
                # bucket and hash are independent, so both together tell windows apart
                bucket = (words.window_hash(asked, window, 1) >> U64(32)) * U64(buckets) >> U64(32)
                held.append((words.window_hash(asked, window), bucket.astype(np.int32), ids[lo + words.text[asked]]))
                size += len(asked)
                if size >= FLUSH:
                    yield _gather(held, buckets, True)
                    held, size = [], 0
        if size:
            yield _gather(held, buckets, True)

    return send


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each run of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
    return edges[:-1], edges[1:]


def _repeats(later: bool, dtype: type, shards: int):
    """Of a bucket, the repeated hashes of each document, a row for each shard of documents; what is known already is passed on."""

    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf[pdf["kind"] == 1]
        blobs = [np.frombuffer(x, dtype) for x in ready["hashes"]]
        found = [(x, np.repeat(np.frombuffer(d, np.int64), len(x))) for d, x in zip(ready["docs"], blobs, strict=True)]
        own = pdf[pdf["kind"] == 0]
        if len(own):
            h, doc, shared = _arrived(own["hashes"], own["docs"], own["shared"], dtype)
            order = np.lexsort((doc, h))
            h, doc, shared = h[order], doc[order], shared[order]
            begins, ends = _runs(h)
            group = np.repeat(np.arange(len(begins)), ends - begins)
            if later:
                known = doc > doc[begins][group]
            else:
                known = ((doc[begins] != doc[ends - 1]) | np.logical_or.reduceat(shared, begins))[group]
            found.append((h[known], doc[known]))
        h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        shard = doc % shards
        order = np.lexsort((doc, shard))
        h, doc, shard = h[order], doc[order], shard[order]
        out = []
        for lo, hi in zip(*_runs(shard), strict=True):
            begins, ends = _runs(doc[lo:hi])
            out.append((int(shard[lo]), doc[lo:hi][begins].tobytes(), (ends - begins).astype(np.int32).tobytes(), h[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=["shard", "docs", "counts", "hashes"])

    return repeats


def _by_shard(dtype: type):
    """The repeated hashes of each document of a shard, from all buckets."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.int32)) for d, n in zip(pdf["docs"], pdf["counts"], strict=True)])
        h = np.concatenate([np.frombuffer(x, dtype) for x in pdf["hashes"]])
        return pd.DataFrame(list(_by_document(h, doc)), columns=["doc_id", "hashes"])

    return gather


def _repeated(docs: DataFrame, send, later: bool, buckets: int, coarse: int, tag: str) -> DataFrame:
    """(doc_id, hashes binary) of the documents with repeated hashes.

    A map task sends a row to each bucket it has hashes for. Many tasks times
    many buckets would be slivers, so beyond coarse buckets each is cut into
    finer ones by the task that holds it. Buckets answer to shards of documents,
    again with a row for each, and shards tell the documents.
    """
    each = -(-buckets // coarse)
    dtype = U64 if later or each > 1 else np.uint32
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    sent = docs.mapInArrow(send, SENT)
    if each > 1:
        sent = sent.repartition(coarse, "bucket").mapInArrow(_cut_finer(each, later), SENT)
    found = sent.groupBy("bucket").applyInPandas(_repeats(later, dtype, shards), "shard int, docs binary, counts binary, hashes binary")
    return keep(found.groupBy("shard").applyInPandas(_by_shard(dtype), "doc_id long, hashes binary"), tag)


def _with_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of the documents in found. If their ids are few enough to broadcast, other texts are not shuffled."""
    ids = found.select("doc_id")
    if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(found, "doc_id").select("doc_id", "text", "hashes")


def _strip(window: int, give_text: bool):
    """Words, removed words, and the kept words' digest (or text) of rows (doc_id, text, hashes)."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                lists = batch.column(2) if batch.num_columns > 2 else None
                words = Words(raw, at, hashes=lists is not None)
                kept = np.ones(len(words), bool)
                if lists is not None:
                    start, h = words.windows(window)
                    edge = np.searchsorted(start, words.offsets)
                    for i in range(hi - lo):
                        here = slice(edge[i], edge[i + 1])
                        known = np.frombuffer(lists[lo + i].as_buffer(), U64)
                        hit = start[here][np.isin(h[here], known)]
                        for j in range(window):
                            kept[hit + j] = False
                out, gone = [], []
                for i in range(hi - lo):
                    a, b = words.offsets[i], words.offsets[i + 1]
                    text = raw[at[i] : at[i + 1]].tobytes().split()
                    if not kept[a:b].all():
                        text = [w for w, k in zip(text, kept[a:b], strict=True) if k]
                    gone.append(int(b - a) - len(text))
                    text = b" ".join(text)
                    out.append(text.decode() if give_text else hashlib.sha256(text).hexdigest())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(words.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return strip


def remove_repeats(docs: DataFrame, window: int = 13, give_text: bool = True, bucket_bytes: int = BUCKET_BYTES, coarse: int = COARSE) -> DataFrame:
    """Remove words of windows that start in a document with a smaller doc_id too: doc_id, n_words, n_removed, kept.

    Words are [^\\x20\\x09-\\x0D]+ of docs (doc_id, text), unchanged; kept are the
    words left, joined by one space, or their SHA-256 in hex if not give_text.
    Windows are judged on the input.

    1. Anchors at cover positions are dealt to buckets by hash; a bucket tells each
       document which of its anchors another document has.
    2. Only windows around such anchors are hashed whole; dealt to buckets, they
       tell each document which of its windows a smaller doc_id has.
    3. Documents concerned are read once more and lose those windows' words.

    There is a bucket for each bucket_bytes of text, and one for each shuffle
    partition at least, so what a task holds at once doesn't grow with the
    corpus. Beyond coarse buckets, hashes are dealt in two steps.

    A null text has no words. Rows with a null doc_id lose nothing and take
    nothing from others. Rows that share a doc_id don't take words from each
    other; each is returned. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = docs.where("doc_id is not null")
    total = named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    coarse = min(coarse, buckets)
    dtype = np.uint32 if buckets == coarse else U64
    near = _repeated(named, _send_anchors(window, coarse, dtype), False, buckets, coarse, "anchors")
    found = _repeated(_with_texts(named, near), _send_windows(window, coarse, dtype), True, buckets, coarse, "windows")

    result = "doc_id long, n_words long, n_removed long, kept string"
    cut = keep(_with_texts(named, found).mapInArrow(_strip(window, give_text), result), "cut")
    ids = found.select("doc_id")
    if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    whole = docs.join(ids, "doc_id", "left_anti").mapInArrow(_strip(window, give_text), result)
    return whole.unionByName(cut)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document that a smaller doc_id has in a window of 13 words, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 13, give_text=False).withColumnRenamed("kept", "kept_sha256")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT x, min(doc_id) AS m FROM s GROUP BY x HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (x) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
