"""Containment, vector joins, verdict chains and modes against plain loops, with hot keys and odd rows."""

from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketspark.functions import containment
from ticketspark.functions.containment import contained
from ticketspark.functions.extract import normalize_entity
from ticketspark.operators import grouping, recurrence, similarity, vector_join
from ticketspark.sources import written

# --- containment


def strings(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab\n c街道𝄞é") for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("few", "split_rows"), [(200, 10_000), (0, 3)])
def test_contained_names_equal_a_nested_loop(spark, few, split_rows):
    texts = [(i, t) for i, t in enumerate(strings(300, 1) + [None, "", "ab" * 5000])] + [(None, "ab"), (3, "cc街"), (3, "cc街")]
    names = strings(150, 2, 4) + strings(60, 3, 9) + [t[3:20] for _, t in texts[:200] if t and len(t) > 20] + ["ab" * 900, "", None, "ab", "ab"]
    t = spark.createDataFrame([(i, x, 1) for i, x in texts], "id long, text string, name int").repartition(5)
    n = spark.createDataFrame([(x, 2) for x in names], "name string, id int")
    before = written.paths()
    got = [tuple(r) for r in contained(t, n, at_once=0, few=few, split_rows=split_rows).collect()]
    expected = {(i, n) for i, t in texts for n in set(names) if i is not None and t and n and n in t}
    assert set(got) == expected and len(got) == len(expected)
    # all that was written on the way is deleted but for the pairs
    assert len(written.paths()) == len(before) + 1
    few_names = n.limit(20)
    assert {tuple(r) for r in contained(t, few_names).collect()} == {p for p in expected if p[1] in set(names[:20])}


def test_names_in_several_scans_and_by_ids_of_another_kind(spark):
    texts, names = strings(200, 5) + ["x" * 300_000 + "middle" + "y" * 300_000], strings(120, 6, 5) + ["xxmid", "middley", "y" * 200_000]
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "id string, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = [tuple(r) for r in contained(t, n, scan_names=40).collect()]
    expected = {(f"t{i}", x) for i, t in enumerate(texts) for x in set(names) if x and x in t}
    assert set(got) == expected and len(got) == len(expected)


def test_what_is_written_grows_with_the_pairs_and_not_with_the_parts_of_texts(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(containment, "written", lambda df, plain=written.written: (lambda out: rows.append(out.count()) or out)(plain(df)))
    rng = random.Random(7)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(4, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(500)) for _ in range(300)]
    names = {" ".join(rng.choice(texts).split()[k : k + 2]) for k in range(0, 498, 3)}
    found = contained(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(x,) for x in names], "name string"))
    expected = {(i, x) for i, t in enumerate(texts) for x in names if x in t}
    assert {tuple(r) for r in found.collect()} == expected
    assert sum(rows) < 3 * (len(expected) + len(names))


def test_names_that_begin_alike_write_rows_for_pairs_not_for_parts(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(containment, "written", lambda df, plain=written.written: (lambda out: rows.append(out.count()) or out)(plain(df)))
    aliases = [f"Customer#{i:09d}" for i in range(1500)]
    names = [(a[:-1], f"Messrs {a} & Co", a[9:], f"{a}?")[i % 4] for i, a in enumerate(aliases)]
    a = spark.createDataFrame([(f"C{i}", x) for i, x in enumerate(aliases)], "canonical string, alias string")
    got = {r.k: (r.canonical, r.confidence) for r in normalize_entity(spark.createDataFrame(list(enumerate(names)), "k long, name string"), "k", "name", a).collect()}
    assert got == {i: (min(f"C{j}" for j, x in enumerate(aliases) if x in n or n in x), 0.7) for i, n in enumerate(names)}
    pairs = sum(x in n or n in x for n in set(names) for x in aliases)
    assert sum(rows) < 3 * (len(names) + len(aliases) + pairs)


def test_places_in_the_map_lose_no_name(monkeypatch):
    """Chunks, blocks and pieces of a few bytes, a map with hardly a free bit, and names of every length."""
    for at, size in (("CHUNK", 64), ("TRIED", 32), ("GIVEN", 50), ("LONG", 9)):
        monkeypatch.setattr(containment, at, size)
    texts = [t.encode() for t in strings(60, 8, 60) if t]
    names = sorted({t[a : a + n] for i, t in enumerate(texts) for a, n in [(i % 7, 1 + i % 50)] if t[a : a + n]} | {b"ab", b"c", b"\x97"})
    batch = lambda *columns: [pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])]
    for bits, most in ((16, 1.05), (8, 1e9)):
        marks = np.zeros(1 << bits, bool)
        for b in containment._slots_of_names(bits)(iter(batch(pa.array(names, pa.binary())))):
            marks[b.column(0).to_numpy()] = True
        shared = SimpleNamespace(value=(bits, np.unique([len(n) for n in names]), np.packbits(marks, bitorder="little")))
        got = [(i, n) for b in containment._hits(shared)(iter(batch(pa.array(range(len(texts))), pa.array(texts, pa.binary())))) for i, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        expected = {(i, n) for i, t in enumerate(texts) for n in names if n in t}
        assert expected <= set(got) and len(set(got)) <= most * len(expected)
        assert all(n in texts[i] for i, n in got)


def test_no_names_and_no_texts(spark):
    none = spark.createDataFrame([], "id long, text string")
    names = spark.createDataFrame([(f"name {i}",) for i in range(100)], "name string")
    assert contained(none, names).collect() == [] == contained(spark.createDataFrame([(1, "x")], none.schema), names.limit(0)).collect()


def test_many_aliases_without_a_nested_loop(spark):
    """20,000 names and 20,000 aliases, half of which begin alike; candidates stay near the pairs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    aliases = [("City of " if i % 2 else "") + word() for i in range(20_000)]
    names = [a[1:] if i % 3 == 0 else f"{a} Ltd" if i % 3 == 1 else word() for i, a in enumerate(aliases)]
    a = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(aliases)], "canonical string, alias string")
    d = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    got = {r.k: (r.canonical, r.confidence) for r in normalize_entity(d, "k", "name", a).collect()}
    assert all(got[i] == (f"c{i}", 0.7) for i in range(20_000) if i % 3 < 2)


# --- vectors


def plain_pairs(rows, threshold):
    u = {i: np.asarray(v) / np.linalg.norm(v) for i, v in rows}
    ids = sorted(u)
    return {(a, b): float(u[a] @ u[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold}


def clusters(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim))
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))
    v[: n // 4] = v[0]  # a quarter are copies
    return [(i, v[i].tolist()) for i in range(n)]


ODD = [(5000, None), (5001, []), (5002, [0.0] * 12), (5003, [1.0] * 11 + [None]), (5004, [float("nan")] * 12), (None, [1.0] * 12), (5005, [float("-inf")] * 12)]


@pytest.fixture
def small_cells(monkeypatch):
    for f in ("close_pairs", "nearest"):
        monkeypatch.setattr(similarity, f, lambda *a, f=getattr(vector_join, f): f(*a, cell_rows=25, piece_bytes=3000))


def test_close_pairs_are_exact_over_cells_and_pieces(spark, small_cells):
    rows = clusters(260, 12, 1) + [(1000 + i, v) for i, v in clusters(60, 5, 2)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + ODD], "key long, v array<double>, id int").repartition(4)
    for threshold in (0.3, 0.9):
        got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, "key", "v", threshold, top_k=None, max_pairs=None).collect()}
        expected = plain_pairs(rows, threshold)
        assert got.keys() == expected.keys() and all(abs(got[p] - s) < 1e-9 for p, s in expected.items())
    with pytest.raises(ValueError, match="likeness"):
        similarity.similar_pairs(df, "key", "v", 0.0)


def test_all_pairs_of_tight_copies_in_tiles(spark, small_cells, monkeypatch):
    """A vector with more than 100 close partners keeps all of them; copies meet in pieces, close ones a few at a time."""
    monkeypatch.setattr(similarity, "COPIES", 7)
    monkeypatch.setattr(vector_join, "DOTS", 10)
    monkeypatch.setattr(vector_join, "CHUNK", 20)
    rng = np.random.default_rng(13)
    v = np.ones(6) + 0.01 * rng.normal(size=(240, 6))
    v[:40], v[60:63], v[200:] = v[0], v[60], rng.normal(size=(40, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [(300, [0.0] * 6)], "key long, v array<double>").repartition(3)
    got = similarity.similar_pairs(df, "key", "v", 0.9, top_k=None, max_pairs=None).collect()
    expected = plain_pairs(rows, 0.9)
    assert len(got) == len(expected) > 19_000 and {(r.a, r.b) for r in got} == expected.keys()
    assert all(abs(r.similarity - expected[r.a, r.b]) < 1e-9 for r in got)


def test_nearest_rows_are_exact_over_cells_and_pieces(spark, small_cells):
    rows = clusters(220, 12, 3) + [(1000 + i, v) for i, v in clusters(4, 5, 4)]
    df = spark.createDataFrame(rows + ODD, "key long, v array<double>").repartition(4)
    got = {}
    for r in similarity.nearest_rows(df, "key", "v", 6).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    u = {i: np.asarray(v) / np.linalg.norm(v) for i, v in rows}
    same = {i: tuple(v) for i, v in rows}
    assert got.keys() == u.keys()
    for i, found in got.items():
        scores = sorted((-1.0 if same[i] == same[x] else -float(u[i] @ u[x]), x) for x in u if x != i and len(u[x]) == len(u[i]))[:6]
        assert [n for n, _, _ in sorted(found)] == list(range(1, len(scores) + 1))
        assert all(abs(s + e) < 1e-9 for (_, _, s), (e, _) in zip(sorted(found), scores, strict=True))
        assert [x for _, x, s in sorted(found) if s > 1 - 1e-12] == [x for e, x in scores if e < -1 + 1e-12]


def test_cells_of_clustered_vectors_are_few_to_ask(spark):
    """Where vectors form clusters, the vectors are asked in few cells, however many there are."""
    rng = np.random.default_rng(6)
    per_row = []
    for n in (4000, 16_000):
        centres = rng.normal(size=(n // 100, 32))
        v = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, 32))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        cells = vector_join.Cells(spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>"), 0.5)
        per_row.append(cells.visits(cells.homes.withColumn("radius", F.lit(0.5)), True).count() / n)
    assert per_row[1] < 1.5 * per_row[0] + 0.5 < 6


def test_dense_groups_equal_a_plain_search(spark, small_cells):
    rows = clusters(120, 12, 9, 0.8)
    near = {}
    for a, b in plain_pairs(rows, 0.6):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core = {i for i, x in near.items() if len(x) + 1 >= 5}
    label = {}
    for i in sorted(core):
        todo = [i] if i not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x] & core
    for i in near.keys() - core:
        if near[i] & core:
            label[i] = min(label[x] for x in near[i] & core)
    df = spark.createDataFrame(rows + ODD, "id long, v array<double>")
    got = {r.id: r.cluster_id for r in similarity.dense_groups(df, "id", "v", 0.6, 5).collect()}
    assert got == {i: label.get(i) for i, _ in rows + ODD}


# --- verdicts


def plain_heads(links):
    out = {}
    for node in links:
        path, x = [], node
        while x in links and x not in path:
            path.append(x)
            x = links[x]
        out[node] = min(path[path.index(x) :]) if x in path else x
    return out


def test_ends_of_random_links(spark):
    rng = random.Random(2)
    for n in (1, 5, 60, 400):
        links = {i: rng.randrange(2 * n) for i in range(n)}
        links = {a: b for a, b in links.items() if a != b}
        # a long tail that rises into a cycle, which no round would notice by its least node alone
        links |= {i: i + 1 for i in range(1000, 1037)} | {1037: 1030}
        df = spark.createDataFrame(list(links.items()), "node long, to long")
        assert {r.node: r["head"] for r in grouping.ends_of(df).collect()} == plain_heads(links)
    assert grouping.ends_of(df.limit(0)).collect() == []


def test_a_chain_of_a_hundred_thousand_verdicts(spark, monkeypatch):
    rounds = []
    plain = written.written
    monkeypatch.setattr(grouping, "written", lambda df: rounds.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or plain(df))
    n = 100_000
    verdicts = spark.range(1, n).select(F.col("id").alias("small"), (F.col("id") - 1).alias("big"), F.lit(True).alias("same"), F.col("id").alias("_seq"))
    out = grouping.merge_by_verdict(spark.range(n).select(F.col("id").alias("cluster_id")), verdicts)
    assert out.select("cluster_id").distinct().collect() == [(0,)]
    assert len(rounds) <= 2 + 18 and max(rounds[3:]) < 1.05 * min(rounds[3:])


# --- modes


def test_modes_of_a_hot_group(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 1000 == 0, F.col("id") % 7).otherwise(-5).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("  ").alias("v"), F.lit(None).cast("string").alias("w"))
    df = df.unionByName(spark.createDataFrame([(-5, "b", ""), (-5, "b", ""), (-5, "a", ""), (-5, "a", ""), (99, None, " ")], "k long, v string, w string"))
    got = {r.k: (r.v, r.w) for r in recurrence.modes(df, "k", {"v": F.col("v"), "w": F.col("w")}).collect()}
    assert got[-5] == ("a", None) and 99 not in got
    assert {r.k: r["mode"] for r in recurrence.group_mode(df, "k", "w").collect()} == dict.fromkeys([*range(7), -5, 99], "")
    expected = Counter(i % 7 for i in range(0, 200_000, 1000))
    assert set(got) == {-5, *expected}


def test_measures_of_spans_next_to_whole_days_and_of_ties(spark):
    """Fractions of a second count, and hundredths are rounded as the double is, not as it is shown."""
    from datetime import datetime, timedelta

    began = datetime(2024, 1, 1, 10, 0, 0, 900_000)
    # (rows, span): a tenth of a second short of two days, two days, and 23 rows in 40 days (0.575, a little less as a double)
    groups = {1: (4, timedelta(days=2) - timedelta(seconds=0.8)), 2: (4, timedelta(days=2)), 3: (23, timedelta(days=40)), 4: (3, timedelta(0))}
    rows = [(k, began + (span if i else timedelta(0)), "s", "a") for k, (n, span) in groups.items() for i in range(n)]
    df = spark.createDataFrame(rows, "cluster_id long, t timestamp, extracted_subject string, extracted_area string")
    for kind in ("timestamp", "timestamp_ntz"):
        got = {r.cluster_id: (r.span_days, r.daily_avg) for r in recurrence.recurrence_metrics(df.withColumn("submit_time", F.col("t").cast(kind))).collect()}
        assert got == {1: ("1 天", 4.0), 2: ("2 天", 2.0), 3: ("40 天", round(23 / 40 * 100) / 100), 4: ("1 天", 3.0)}


def test_noise_is_copied_a_few_times_however_many_vectors_there_are(spark):
    """Where every cell is asked, there are few cells: copies of a vector don't grow with the table."""
    v = np.random.default_rng(8).normal(size=(40_000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cells = vector_join.Cells(spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>"), 1.0)
    assert cells.visits(cells.homes.withColumn("radius", F.lit(1.0)), False).count() < 8 * 40_000


def test_pieces_are_smaller_where_more_pairs_are_close(spark):
    v = np.random.default_rng(9).normal(size=(4500, 8)) * 0.01 + 1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cells = vector_join.Cells(spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>"), 0.3, threshold=0.9)
    assert cells.most_rows <= vector_join.PIECE_PAIRS**0.5


def test_dense_groups_make_no_pairs(spark, small_cells, monkeypatch):
    monkeypatch.setattr(similarity, "similar_pairs", None)
    rows = [(i, [1.0, 0.0] if i < 3000 else [0.0, 1.0] if i < 3002 else [-1.0, 0.0]) for i in range(3003)]
    got = {r.id: r.cluster_id for r in similarity.dense_groups(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.9, 3).collect()}
    assert got == {i: 0 if i < 3000 else None for i in range(3003)}


def test_duplicates_by_fields_that_go_with_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "alike_pairs", lambda *a: vector_join.alike_pairs(*a, cell_rows=25, piece_bytes=3000))
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(i, v, pick("A", "B", "", " A ", None), pick("x", "y", None), pick(1, 2, None), pick("r", ""), "") for i, v in clusters(150, 12, 11)]
    df = spark.createDataFrame(rows + [(i, v, "A", "x", 1, "r", "") for i, v in ODD], "id long, v array<double>, organization string, address string, event_type int, request string, time_start string").repartition(3)
    field = lambda r, n: (str(r[n]).strip() or None) if r[n] is not None else None
    same = lambda a, b, n: field(rows[a], n) is not None and field(rows[a], n) == field(rows[b], n)
    expected = {}
    for (a, b), s in plain_pairs([(r[0], r[1]) for r in rows], 0.5).items():
        expected[a, b] = s, sum(w for n, w in ((2, 3), (3, 3), (4, 2), (5, 1)) if same(a, b, n)), same(a, b, 2) or same(a, b, 3)
    pairs = similarity.duplicate_candidates(df, "id", "v", 0.5)
    assert {"organization_same", "time_start_same"} <= set(pairs.columns)
    got = {(r.a, r.b): round(10 * r.score) for r in similarity.judge_duplicates(pairs, df, "id", close=2.0).collect()}
    assert got == {p: tenths for p, (_, tenths, some) in expected.items() if some} and got
    plain = {(r.a, r.b): round(10 * r.score) for r in similarity.judge_duplicates(pairs.select("a", "b", "similarity"), df, "id", close=2.0).collect()}
    assert plain == got
    likely = {(r.a, r.b) for r in similarity.likely_duplicates(df, "id", "v", 0.5).collect()}
    assert likely == {p for p, (_, tenths, _) in expected.items() if tenths >= 6} and likely
