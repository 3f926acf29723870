"""Resampling, the Merkle manifest and nearest neighbours against plain loops, with odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketspark.llm import neighbours, resampling
from ticketspark.llm.merkle import Block, leaf_digest, merkle_manifest
from ticketspark.llm.numbering import placed

# --- resampling


def features_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words)]


def plain_resample(docs, target, percent, min_words, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features_of(t)[1])
    t = Counter(bucket(f) for x in target for f in features_of(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000.0 * math.log((t[b] + 1.0) * (ss + float(buckets)) / ((s[b] + 1.0) * (tt + float(buckets))))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        n, found = features_of(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = None if doc is None else int(sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        rows.append([doc, n, len(found), weight, score, None])
    able = sorted((r for r in rows if r[0] is not None and r[1] >= min_words), key=lambda r: (-r[4], r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return Counter(map(tuple, rows))


VOCABULARY = ["alpha", "Beta", "ÉTÉ", "naïve", "日本", "x1", "gamma-delta", "Ωmega", "the", "of"]


def documents(n, seed=3):
    rng = np.random.default_rng(seed)
    sep = [" ", "\n", ", ", "--", "\x00"]
    texts = ["".join(rng.choice(VOCABULARY) + rng.choice(sep) for _ in range(rng.integers(0, 60))) for _ in range(n)]
    return list(enumerate(texts))


ODD = [(9001, None), (9002, ""), (9003, " .,!\x00"), (None, "alpha beta " * 20), (9004, "ABC"), (9005, "a" * 70_000 + " b " + "c" * 70_000), (9006, "alpha beta " * 4000), (9007, "alpha beta " * 4000)]


def test_resampling_equals_plain_loops(spark):
    docs, target = documents(300) + ODD, ["alpha beta", "the of the of", None, "ÉTÉ naïve 日本"]
    # columns whose names clash with those of the operator take no part
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "id long, text string, score int, rank int, features int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.importance_resample(d, t, percent=7, min_words=20, buckets=501).collect()
    assert Counter(map(tuple, got)) == plain_resample(docs, target, 7, 20, 501)


def test_resampling_in_small_slices(spark, monkeypatch):
    text = documents(1, 5)[0][1] + "alpha beta gamma " * 50
    whole = resampling.text_features(*bytes_of([text, "", text]), 10_000)
    monkeypatch.setattr(resampling, "SLICE_WORDS", 7)
    monkeypatch.setattr(resampling, "MATRIX_BYTES", 64)
    counts, found = resampling.text_features(*bytes_of([text, "", text]), 10_000)
    assert counts.tolist() == whole[0].tolist() and found == whole[1]
    n, features = features_of(text)
    assert counts.tolist() == [n, 0, n]
    assert sorted(np.frombuffer(found[0], np.uint16).tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)


def bytes_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_crc_of_ranges_and_of_rows_with_one_sign(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 4, 5000).astype(np.uint8)
    start, length = rng.integers(0, 4900, 2000), rng.integers(0, 60, 2000)
    expected = [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(start, length, strict=True)]
    assert resampling.crc_ranges(raw, start, length).tolist() == expected
    # with a sign that says nothing, rows are still told apart
    monkeypatch.setattr(resampling, "MULTIPLIER", np.uint64(0))
    assert resampling.crc_ranges(raw, start, length).tolist() == expected


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    some = spark.createDataFrame([(1, "a b " * 15), (2, "c")], "id long, text string")
    assert resampling.importance_resample(none, some).collect() == []
    rows = resampling.importance_resample(some, none.select("text"), percent=100).collect()
    assert Counter(map(tuple, rows)) == plain_resample([(1, "a b " * 15), (2, "c")], [], 100, 20, 10_000)


def test_places_of_a_hot_group_and_of_ties(spark):
    rows = [("hot", i % 50) for i in range(3000)] + [("cold", i) for i in range(7)] + [("", 1)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = placed(df, "g", [F.desc("x")]).collect()
    for g in ("hot", "cold", ""):
        own = sorted((r for r in got if r.g == g), key=lambda r: r["__place"])
        assert [r["__place"] for r in own] == list(range(len(own))) and {r["__of"] for r in own} == {len(own)}
        assert [r.x for r in own] == sorted((r.x for r in own), reverse=True)


# --- manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_manifest(rows):
    """rows (group, id, leaf, altered) to Counter of (id, leaf, subroot, root, proof, folded, copies)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))]) for g in keys}
    top = plain_tree([trees[g][-1][0] for g in keys])
    out = Counter()
    for at, g in enumerate(keys):
        for i, (_, doc, leaf, altered) in enumerate(sorted(groups[g], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))):
            siblings, node, copies = [], altered or leaf, []
            for levels, slot in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    other = level[slot ^ 1] if slot ^ 1 < len(level) else ""
                    node = H(other, node) if slot % 2 else H(node, other)
                    siblings.append(other)
                    copies.append(node)
                    slot >>= 1
            out[(doc, leaf, trees[g][-1][0], top[-1][0], H(*siblings), node, tuple(copies) if altered else None)] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_a_plain_tree(spark, levels):
    rng = np.random.default_rng(levels)
    rows = []
    for g, n in {"en": 37, "de": 1, None: 5, "": 2, "été": 8, "zz": 16, "日本": 3}.items():
        rows += [(g, int(i), H(str(g), str(i)), H("other", str(i)) if rng.random() < 0.4 else None) for i in rng.permutation(n * 3)[:n]]
    # repeated rows, an id twice with different leaves, ids that are null
    rows += [rows[0], ("en", 5, H("again"), None), ("en", None, H("null"), H("changed")), ("zz", None, H("null"), None)]
    df = spark.createDataFrame(rows, '"group" string, id long, leaf string, altered string'.replace('"', "`")).withColumns({"root": F.lit(1), "key": F.lit(2)}).repartition(4)
    got = merkle_manifest(df, levels=levels, with_copies=True).collect()
    found = Counter((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, tuple(r.copied_nodes) if r.copied_nodes is not None else None) for r in got)
    assert found == plain_manifest(rows)
    assert all(r.altered == (r.folded_root != r.root) for r in got)


def test_manifest_of_none_and_of_one(spark):
    df = spark.createDataFrame([], "`group` string, id long, leaf string, altered string")
    assert merkle_manifest(df).collect() == []
    one = spark.createDataFrame([("a", 1, H("x"), None)], df.schema)
    (row,) = merkle_manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == H("x") and row.proof_sha256 == H("")


def test_a_version_shares_all_but_the_path():
    nodes = [bytes([i]) * 32 for i in range(11)]
    block = Block(nodes, 4)
    changed = Block([*nodes[:6], b"\xff" * 32, *nodes[7:]], 4)
    assert Block.version(b"\xff" * 32, block.path(6)) == [changed.levels[i + 1][6 >> (i + 1)] for i in range(4)]
    for level in range(5):
        own = 6 >> level
        assert [n for i, n in enumerate(changed.levels[level]) if i != own] == [n for i, n in enumerate(block.levels[level]) if i != own]


def test_leaf_tells_null_from_empty_and_counts_bytes(spark):
    df = spark.createDataFrame([(1, None, "é"), (None, "", "-")], "a long, b string, c string")
    got = [r[0] for r in df.select(leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [H("1:1", "-", "2:é"), H("-", "0:", "1:-")]


# --- nearest neighbours


def plain_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        scores = []
        for x, w in rows:
            if x != q and len(v) == len(w):
                total = 0.0
                for a, b in zip(v, w, strict=True):
                    total += float(a) * float(b)
                scores.append((-total, x))
        out += [(q, i + 1, x, -s) for i, (s, x) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[: n // 3] = v[0]  # a third are copies of one
    v[n // 3 : n // 2] *= rng.choice([1e-3, 1, 1e6], (n // 2 - n // 3, 1)).astype(np.float32)
    return [(i, v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("group_bytes", [3000, 1 << 25])
def test_neighbours_equal_plain_loops(spark, group_bytes, monkeypatch):
    monkeypatch.setattr(neighbours, "FAN_IN", 3)
    rows = vectors(400, 24, 1) + [(1000 + i, v) for i, v in vectors(30, 7, 2)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0] * 23 + [None]), (2004, [float("nan")] * 24), (2005, [float("inf")] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, score int, part int").repartition(6)
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 9 = 0"), 5, group_bytes=group_bytes)
    assert sorted(map(tuple, got.collect())) == plain_nearest(rows, [r for r in rows if r[0] % 9 == 0], 5)


def test_few_candidates_repeated_rows_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(1, [1.0, 0.5]), (2, [1e-320, 0.0]), (2, [1e-320, 0.0]), (3, [-2.0, 1.0])], schema)
    got = sorted(map(tuple, neighbours.nearest_neighbours(df, df.where("vec_id < 3"), 20).collect()))
    assert [r[:3] for r in got] == [(1, 1, 2), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 3)]
    none = spark.createDataFrame([], schema)
    assert neighbours.nearest_neighbours(df, none, 3).collect() == [] == neighbours.nearest_neighbours(none, df, 3).collect()


def test_bounds_hold_and_leave_few_pairs():
    rng = np.random.default_rng(5)
    v, w = rng.normal(size=(300, 64)), rng.normal(size=(2000, 64))
    (cq, sq, eq, nq), (cw, sw, ew, nw) = neighbours.quantise(v), neighbours.quantise(w)
    product = (cq.astype(float) @ cw.astype(float).T) * np.multiply.outer(sq, sw)
    bound = np.multiply.outer(nq + eq, ew) + np.multiply.outer(eq, nw)
    assert (np.abs(v @ w.T - product) <= bound).all()
    side = lambda ids, x: neighbours._Side({"dim": 64, "ids": ids.tobytes(), "vectors": x.tobytes()} | dict(zip(("codes", "scales", "errors", "norms"), (a.tobytes() for a in neighbours.quantise(x)), strict=True)))
    heaps = neighbours.Heaps(side(np.arange(300), v), 20)
    heaps.add(side(np.arange(1000, 3000), w))
    assert heaps.recomputed < 0.05 * 300 * 2000
    recall = np.mean([len({-x for _, x in h} & set((1000 + np.argsort(-(w @ q))[:20]).tolist())) / 20 for h, q in zip(heaps.heaps, v, strict=True)])
    assert recall == 1.0
