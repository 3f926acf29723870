"""MinHash near-duplicates: banded candidates, odd-sketch estimates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, keep, written
from .textops import U64, Words, chunks, mix, small_batches

#: Document ids that are broadcast to keep other texts out of a shuffle; more ids are joined by shuffle alone.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Plan:
    """Shingle size, similarity in hundredths, and the shape of signatures.

    A signature has bands * rows MinHash samples. At similarity s a pair shares a
    band with probability 1 - (1 - s**rows)**bands: 0.999997 at 0.8. The samples
    are folded into an odd sketch of sketch_bits bits. A pair whose estimated
    similarity is under sketch_floor is dropped unconfirmed; for a similarity of
    0.8 that is five standard deviations away. An odd sketch of the full set
    stands beside it: its XOR counts at most as many elements as the sets differ
    in, so a pair it drops is surely not similar. rounds says how often buckets
    are thinned before their remaining pairs are compared, and tries how many
    comparisons a member gets in a round. What is left of a bucket is compared in
    tiles of tile members a side, whatever its size: a size decides where a
    pair is compared, never whether.
    """

    shingle: int = 5
    similar: int = 80
    bands: int = 32
    rows: int = 5
    sketch_bits: int = 512
    sketch_floor: float = 0.62
    rounds: int = 2
    tries: int = 6
    tile: int = 2048

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(971)
        return tuple(random.integers(0, 1 << 32, (2, self.samples, 1), dtype=np.uint32) | np.uint32(1))


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text with fewer words has its whole sequence as one."""
    words = Words(raw, at, lower=True)
    start, h = words.windows(size)
    ends = np.searchsorted(start, words.offsets)
    out = []
    for i, n in enumerate(words.counts):
        if n >= size:
            x = np.sort(h[ends[i] : ends[i + 1]])
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            out.append(x[new])
        elif n:
            out.append(words.window_hash(words.offsets[i : i + 1], int(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def digest(x: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    both = (mix(x ^ U64(0x51ED270B7A1F3C25)).sum(dtype=U64), mix(x ^ U64(0xC3A5C85C97CB3127)).sum(dtype=U64))
    return tuple(int(np.int64(v.view(np.int64))) for v in both)


def signatures(sets: list[np.ndarray], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and odd sketches of the samples and of the full set, one row for each set, as 64-bit integers."""
    a, b = plan.multipliers()
    least = np.full((len(sets), plan.samples), 0xFFFFFFFF, np.uint32)
    for i, x in enumerate(sets):
        x = (x >> U64(32)).astype(np.uint32)
        for j in range(0, len(x), 2048):
            np.minimum(least[i], (x[j : j + 2048] * a + b).min(1), out=least[i])
    wide = least.astype(U64)
    keys = np.tile(np.arange(1, plan.bands + 1, dtype=U64), (len(sets), 1))
    for j in range(plan.rows):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + wide[:, j :: plan.rows])
    bit = (mix(wide + (np.arange(1, plan.samples + 1, dtype=U64) << U64(32))) & U64(plan.sketch_bits - 1)).astype(np.int64)
    flat = (bit + np.arange(len(sets))[:, None] * plan.sketch_bits).ravel()
    all_bits = np.concatenate([(mix(x) & U64(plan.sketch_bits - 1)).astype(np.int64) + i * plan.sketch_bits for i, x in enumerate(sets)] or [flat])
    marks = []
    for bits in (flat, all_bits):
        odd = (np.bincount(bits, minlength=len(sets) * plan.sketch_bits) & 1).astype(np.uint8)
        marks.append(np.packbits(odd).view(np.int64).reshape(len(sets), plan.sketch_bits // 64))
    return keys.view(np.int64), np.hstack(marks)


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(rows.ravel()))


def _sign(plan: Plan):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                sets = shingle_sets(raw, at, plan.shingle)
                keys, sketch = signatures(sets, plan)
                names = np.array([digest(x) for x in sets], np.int64).reshape(-1, 2)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), _lists(keys), _lists(sketch)]
                yield pa.record_batch(columns, ["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return sign


def _full_sets(plan: Plan):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                sets = shingle_sets(raw, at, plan.shingle)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "set"])

    return full


def _confirm(plan: Plan):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= plan.similar * (len(both) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def odd_bits(x: Column, y: Column, first: int, n: int) -> Column:
    """Population count of the XOR of n 64-bit words of two sketches."""
    return sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(first, first + n)), F.lit(0))


def estimate(x: Column, y: Column, plan: Plan) -> Column:
    """Similarity of two sets by the odd sketches of their samples."""
    odd = odd_bits(x, y, 0, plan.sketch_bits // 64)
    return 1 + plan.sketch_bits / (4 * plan.samples) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * odd / plan.sketch_bits))


def _maybe(n_a: Column, n_b: Column, a: Column, b: Column, plan: Plan) -> Column:
    """Whether sizes and sketches leave room for the similarity asked: sets of it differ in at most (100 - s) / (100 + s) of their sizes' sum."""
    words = plan.sketch_bits // 64
    sizes = 100 * F.least(n_a, n_b) >= plan.similar * F.greatest(n_a, n_b)
    differ = (100 + plan.similar) * odd_bits(a, b, words, words) <= (100 - plan.similar) * (n_a + n_b)
    return sizes & differ & (estimate(a, b, plan) >= plan.sketch_floor)


def _links(close: DataFrame, docs: DataFrame, plan: Plan, tag: str) -> DataFrame:
    """Those of pairs (a, b) of classes whose full sets are as similar as asked."""
    close = keep(close, tag)
    asked = close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()
    # with few ids the other texts are not shuffled
    asked = F.broadcast(asked) if 2 * close.count() <= BROADCAST_IDS else asked
    sets = keep(docs.join(asked, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_full_sets(plan), "doc_id long, set binary").distinct(), tag)
    full = close.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    return keep(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(plan), "a long, b long").distinct(), tag)


def _sketched(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Those of pairs (a, b) whose sizes and sketches leave room for the similarity asked."""
    one = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    return both.where(_maybe(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), plan)).select("a", "b")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, rep, n, component, main) of the buckets whose members are in several components; main is the largest."""
    crowd = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    parts = crowd.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    return keep(crowd.join(parts.where("parts > 1").select("bucket", "main"), "bucket"), "mixed")


def _outsiders(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of mixed buckets outside the main component, with their sketches."""
    return keep(mixed.where("component <> main").join(classes.select("rep", "sketch"), "rep"), "outsiders")


def _room(plan: Plan) -> Column:
    return _maybe(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), plan)


def _pair() -> list[Column]:
    return [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]


def _apart(outside: DataFrame, mixed: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of an outsider and a member of another component of its bucket that sizes and sketches leave possible.

    Sizes of a pair are at most a factor of 100 / plan.similar apart, so a bucket
    is cut into classes of sizes by powers of that, and an outsider meets its own
    class and the two beside it. Both sides of a cut are dealt into groups of
    about plan.tile members, and each group of the one meets each of the other in
    a tile of its own: so a tile takes about plan.tile ** 2 comparisons however
    large the cut is, tiles of a cut spread over tasks, and no pair is left out.
    """
    size_class = F.floor(F.log("n") / F.log(F.lit(100.0 / plan.similar))).cast("int")
    x = outside.withColumn("c", F.explode(F.array(size_class - 1, size_class, size_class + 1)))
    y = mixed.withColumn("c", size_class)
    met = x.groupBy("bucket", "c").agg(F.count("*").alias("nx")).join(y.groupBy("bucket", "c").agg(F.count("*").alias("ny")), ["bucket", "c"])
    groups = lambda n: F.ceil(F.col(n) / plan.tile).cast("long")
    met = keep(met.select("bucket", "c", groups("nx").alias("gx"), groups("ny").alias("gy")), "met")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """A row for each tile (bucket, c, gx, gy) that a member is in."""
        side = side.join(met, ["bucket", "c"]).withColumn("i", F.pmod(F.xxhash64("rep", F.lit(own)), F.col(own)))
        return side.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("gx", "gy").withColumnsRenamed({"i": own, "j": other})

    x, y = dealt(x, "gx", "gy").alias("x"), dealt(y.join(classes.select("rep", "sketch"), "rep"), "gy", "gx").alias("y")
    same_tile = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("bucket", "c", "gx", "gy")]
    # of two outsiders the smaller one asks
    asks = (F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
    return x.join(y, [*same_tile, F.col("x.component") != F.col("y.component"), asks, _room(plan)]).select(*_pair()).distinct()


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Near-duplicate component of every row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; a document's
    set holds its distinct shingles. Documents are linked if their sets'
    similarity reaches plan.similar hundredths; component_id is the smallest
    doc_id reachable, and kept says that it is the row's own.

    1. Documents of equal sets form a class, named by its smallest doc_id; from
       here on only classes are handled, so copies cost one row each.
    2. Each class is compared with the smallest class in each of its buckets
       (equal band), and components are taken of the links found.
    3. In buckets with several components, members outside the largest one are
       compared with one member of that, picked by hash, and components are
       taken again. This is repeated while it finds links, plan.rounds times at most.
    4. In buckets that still have several, members outside the largest are
       compared with all members of other components that are near them in size,
       in tiles that spread over tasks.

    So of the pairs that share a bucket only those are skipped that are connected
    already, and a bucket of one group never yields all its pairs. Pairs are
    first judged by their odd sketches, then confirmed on full sets. Step 4 takes
    the square of a crowd of unlike texts that share a band, as comparisons of 128
    bytes each in the JVM; only pairs that pass them are written.

    A null or text without words has an empty set and links with nothing. A row
    with a null doc_id links with nothing, has a null component_id and is kept.
    Rows that share a doc_id count as one document, linked by what any of them
    says; each is returned. Other columns are ignored. No rows give no rows.
    """
    spark, before = docs.sparkSession, set(written())
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(docs.mapInArrow(_sign(plan), "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"), "signed")
    whole = signed.where("doc_id is not null and n > 0")
    classes = whole.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = keep(classes, "classes")
    needed = set(written())

    members = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = keep(members.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = keep(members.join(shared, "bucket"), "members")
    star = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = _links(_sketched(star, classes, plan), docs, plan, "star")
    found, found_at = components(links, "star"), written()[-1]
    members = members.where("size > 2").select("bucket", "rep", "n")

    mixed = _mixed(members, found)
    outside = _outsiders(mixed, classes)
    left = outside.limit(1).count()
    for turn in range(plan.rounds if left else 0):
        picked = F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(turn)), "rep"))["rep"].alias("rep")
        leaders = keep(mixed.where("component = main").groupBy("bucket").agg(picked).join(classes.select("rep", "n", "sketch"), "rep"), "leaders")
        x, y = outside.alias("x"), leaders.alias("y")
        tried = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & _room(plan)).select(F.col("x.rep").alias("own"), *_pair(), estimate(F.col("x.sketch"), F.col("y.sketch"), plan).alias("guess")).distinct()
        best = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("guess"), "a", "b"))
        tried = tried.withColumn("place", best).where(F.col("place") <= plan.tries).select("a", "b").distinct()
        more = _links(tried, docs, plan, "leaders")
        if not more.limit(1).count():
            break
        links = links.union(more)
        found, found_at = components(links, "leaders"), written()[-1]
        mixed = _mixed(members, found)
        outside = _outsiders(mixed, classes)
        left = outside.limit(1).count()
        if not left:
            break

    if left:
        more = _links(_apart(outside, mixed, classes, plan), docs, plan, "rest")
        if more.limit(1).count():
            found, found_at = components(links.union(more), "all"), written()[-1]

    # the result reads the signatures, the classes and the last components alone
    drop(spark, [p for p in written() if p not in before | needed | {found_at}])
    named = signed.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
    named = named.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by 2-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Plan(shingle=2))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT p, q FROM common JOIN n AS np ON np.doc_id = p JOIN n AS nq ON nq.doc_id = q WHERE 100 * c >= 80 * (np.n + nq.n - c)
),
both_ways AS (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach(p, q) AS (SELECT p, q FROM both_ways UNION SELECT r.p, b.q FROM reach AS r JOIN both_ways AS b ON r.q = b.p)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(q)) AS component_id, d.doc_id <= coalesce(min(q), d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.p = d.doc_id GROUP BY d.doc_id
"""
