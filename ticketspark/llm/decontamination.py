"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .scratch import keep
from .textops import small_batches

#: Bytes that are part of a word once A-Z are lower-cased: 0-9, a-z and everything beyond ASCII.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: One byte to one byte: A-Z lower-cased, every separator a space. Offsets stay those of the UTF-8 text.
NORMAL = bytes(b if b in WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Item texts of at most so many bytes go into one automaton.
AUTOMATON_BYTES = 4 << 20
#: A word is three signs, each of its own alphabet of so many: no node has many children, and a match begins where a word does.
SIGNS, ALPHABET = 3, 128
#: Automata that a scan runs one after another. With more, rows are written with their hits, and scanned again.
CHAINED = 4

#: What a scan says of a row: words, indexes of hit words, items with a window there, hit runs as bytes of the text as given.
HITS = StructType([
    StructField("__n_words", LongType()),
    StructField("__hit_words", ArrayType(IntegerType())),
    StructField("__item_ids", ArrayType(LongType())),
    StructField("__spans", ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))),
])


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text; none if it is null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Matcher:
    """An Aho-Corasick automaton over the words of items, each different word being a number of three signs.

    Any window of size words holds a block of size // 2 words that begins at a
    multiple of that in its item (a block of one word where size is below 4). So
    the automaton takes an item's blocks, three nodes for each word at most, and
    around a found block the text's windows are looked up among those of the
    items. An item of fewer words than size, but not none, is one window and
    goes into the automaton whole. Its items may have 2,097,152 different words
    in all, more than AUTOMATON_BYTES can hold.
    """

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        self.size, self.block = size, max(1, size // 2)
        self.codes: dict[bytes, str] = {}
        short, whole = defaultdict(set), []
        for item, text in items:
            coded = "".join([self._code(w) for w in words_of(text)])
            if len(coded) >= SIGNS * size:
                whole.append((item, coded))
            elif coded:
                short[coded].add(item)
        #: The items' texts one after another, and the word at which each window first stands; owners of a window by its number.
        self.text = "".join(w for _, w in whole)
        self.at, self.owners, self.key = self._windows(whole)
        n = SIGNS * self.block
        blocks = {w[i : i + n] for _, w in whole for i in range(0, len(w) - n + 1, n)}
        self.short = [sorted(x) for x in short.values()]
        number = {w: n for n, w in enumerate(short)}
        self.automaton = ahocorasick.Automaton()
        for w in blocks | short.keys():
            self.automaton.add_word(w, (len(w) // SIGNS, number.get(w, -1), w in blocks))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        found = self.codes.get(word)
        if found is None:
            n = len(self.codes)
            # 0 is left for words of no item
            signs = (1 + n // ALPHABET**2, ALPHABET + 1 + n // ALPHABET % ALPHABET, 2 * ALPHABET + 1 + n % ALPHABET)
            self.codes[word] = found = "".join(map(chr, signs))
        return found

    def _hashes(self, coded: str) -> np.ndarray:
        """A hash of each window of a coded text."""
        signs = np.frombuffer(coded.encode("utf-16-le"), np.uint16).astype(np.uint64).reshape(-1, SIGNS)
        x = (signs[:, 0] << np.uint64(32)) | (signs[:, 1] << np.uint64(16)) | signs[:, 2]
        h = np.zeros(max(0, len(x) - self.size + 1), np.uint64)
        for j in range(self.size):
            h = (h ^ x[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _same(self, coded: str, start: int, at: int) -> bool:
        """Whether the window from word start of a coded text is that from word at of the items."""
        n = SIGNS * self.size
        return coded[SIGNS * start : SIGNS * start + n] == self.text[SIGNS * at : SIGNS * at + n]

    def _windows(self, whole: list[tuple[int, str]]) -> tuple[np.ndarray, list, np.ndarray]:
        """First word in self.text of each different window, its items (edges and ids), and its hash, ascending by that."""
        text = np.repeat(np.arange(len(whole)), [len(w) // SIGNS for _, w in whole])
        place = np.flatnonzero(text[: max(0, len(text) - self.size + 1)] == text[self.size - 1 :])
        hashes = self._hashes(self.text)[place]
        item = np.array([i for i, _ in whole], np.int64)[text[place]]
        order = np.lexsort((item, hashes))
        hashes, place, item = hashes[order], place[order], item[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        edges = np.append(np.flatnonzero(new), len(hashes))
        return place[new], [edges, item], hashes[new]

    def _look_up(self, coded: str, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Those of starts at which a window of the items stands, with its items."""
        hashes = self._hashes(coded)[starts]
        at = np.searchsorted(self.key, hashes)
        for start, h, i in zip(starts, hashes, at, strict=True):
            if i < len(self.key) and self.key[i] == h and self._same(coded, start, self.at[i]):
                edges, item = self.owners
                yield int(start), item[edges[i] : edges[i + 1]]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """First and last word (exclusive) of each occurrence of a window in a text, and the items that have one there."""
        get, unknown = self.codes.get, "\0" * SIGNS
        coded = "".join([get(w, unknown) for w in words])
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        starts: set[int] = set()
        for last, (n, short, block) in self.automaton.iter(coded):
            end = (last + 1) // SIGNS
            if short >= 0:
                found.append((end - n, end))
                items.update(self.short[short])
            if block:
                starts.update(range(max(0, end - self.size), min(end - n + 1, len(words) - self.size + 1)))
        if starts:
            for start, owners in self._look_up(coded, np.array(sorted(starts), np.int64)):
                found.append((start, start + self.size))
                items.update(owners.tolist())
        return found, items


def scan(text: bytes, matcher: Matcher) -> tuple[int, np.ndarray, list[int], list[tuple[int, int]]]:
    """Number of words, indexes of hit words, items found, and the hit runs as byte spans of the text as given."""
    plain = text.translate(NORMAL)
    words = plain.split()
    found, items = matcher.find(words) if words and len(matcher.automaton) else ([], set())
    if not found:
        return len(words), np.zeros(0, np.int64), [], []
    change = np.zeros(len(words) + 1, np.int64)
    for first, last in found:
        change[first] += 1
        change[last] -= 1
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    inside = np.frombuffer(plain, np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return len(words), hit, sorted(items), [(int(starts[r[0]]), int(ends[r[-1]])) for r in runs]


#: The matcher that a worker process built last, by its name.
_built: dict[str, Matcher] = {}


def _matcher(name: str, shared: Broadcast, size: int) -> Matcher:
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(shared.value, size)
    return _built[name]


def _scanner(shared: Broadcast, size: int, text: int, earlier: int | None, carried: list[int], names: list[str]):
    """Scans column number text; hits of an earlier scan, from column number earlier on, are merged."""
    name = uuid.uuid4().hex

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared, size)
        for batch in batches:
            rows = [scan(x.encode("utf-8", "surrogatepass") if x else b"", matcher) for x in (x.as_py() for x in batch.column(text))]
            if earlier is not None:
                before = [batch.column(earlier + i).to_pylist() for i in range(1, 4)]
                rows = [
                    (n, sorted({*hit, *h}), sorted({*ids, *i}), sorted({*spans, *((x["first"], x["last"]) for x in s)}))
                    for (n, hit, ids, spans), h, i, s in zip(rows, *before, strict=True)
                ]
            yield pa.record_batch(
                [
                    *(batch.column(i) for i in carried),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([[{"first": a, "last": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ],
                [*names, *HITS.names],
            )

    return scan_batches


def _parts(items: DataFrame, automaton_bytes: int) -> list[DataFrame]:
    """The items (item_id, text) with text, each once, in parts of about automaton_bytes."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and length(text) > 0").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= automaton_bytes:
        return [items]
    # twice the parts, so that one with more than its share stays within the bound too
    parts = 2 * -(-total // automaton_bytes)
    items = keep(items, "items")
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]


def _annotate(docs: DataFrame, items: DataFrame, size: int, automaton_bytes: int, carried: list[str]) -> DataFrame:
    """The carried columns of docs and the columns HITS. docs has text as its last column, under the name __text."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = _parts(items, automaton_bytes)
    held: list[Broadcast] = []
    for i, part in enumerate(parts):
        held.append(spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()]))
        names = list(dict.fromkeys(carried if i == len(parts) - 1 else [*carried, "__text"]))
        earlier = docs.columns.index("__n_words") if i else None
        schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields, *HITS.fields])
        docs = docs.mapInArrow(_scanner(held[-1], size, docs.columns.index("__text"), earlier, [docs.columns.index(c) for c in names], names), schema)
        if i % CHAINED == CHAINED - 1 and i < len(parts) - 1:
            docs = keep(docs, "scanned")
            while held:
                held.pop().destroy()
    return docs


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Words of docs (doc_id, text) inside windows of size words of items (item_id, text).

    Returns a row for each row of docs: doc_id, n_words, hit_words (indexes of
    hit words), item_ids (items with a window there), spans (hit runs as byte
    offsets of the UTF-8 text as given). Other columns of either table are
    ignored, whatever their names. A null or empty text has no words and no
    hits; a null or empty item, or one with a null id, has no windows; repeated
    rows of docs are each returned; without items nothing is hit; without docs
    there are no rows. Long texts are scanned whole.

    Item texts of up to automaton_bytes are broadcast to one automaton, built
    once in each worker process. Larger item tables are cut by hash into parts
    of that size at most: each part is scanned with its own automaton, and hits
    are merged row by row. After each CHAINED parts the rows are written and
    their automata dropped, so driver and executors never hold them all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"))
    return _annotate(docs, items, size, automaton_bytes, ["doc_id"]).withColumnsRenamed({x: x[2:] for x in HITS.names})


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of docs without a hit word, with all their columns, in the scan that finds the hits. Rows with null text stay."""
    rest = [c for c in docs.columns if c != "text"]
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__")).alias("__row"), F.col("text").cast("string").alias("__text"))
    found = _annotate(boxed, items, size, automaton_bytes, ["__row", "__text"]).where(F.size("__hit_words") == 0)
    return found.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by benchmark windows of 10 words, as digests."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, items, size=10)
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
