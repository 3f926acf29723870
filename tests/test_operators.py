import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketspark.operators import grouping, recurrence, related, rollups, search, similarity
from ticketspark.sources import tickets as src

TICKET = "order_id string, title string, content string, extracted_subject string, extracted_event string, extracted_area string, submit_time timestamp, submitter long, _seq long"


@pytest.fixture
def tickets(spark):
    day = lambda n: datetime(2025, 3, 1 + n, 8, 30)
    rows = [(f"t{i}", "噪音" if i < 6 else "" if i == 9 else "垃圾", f"内容{i}", "甲" if i % 2 else "乙", "", "大良街道", day(i % 4), i % 3, i) for i in range(10)]
    return spark.createDataFrame(rows, TICKET)


def test_headers(spark):
    df = spark.createDataFrame([("a", " 吵 ", "大良", 0), ("a", "再吵", "", 1), ("b", "  ", "", 2)], "`工单编号` string, `诉求内容` string, `事发区域` string, _seq long")
    out = src.load_tickets(df).collect()
    assert [(r.order_id, r.content, r.title, r.area, r.submit_time) for r in out] == [("a", "吵", "", "大良", None)]


def test_absent_ids(spark):
    df = spark.createDataFrame([("x", 0), ("y", 1)], "`诉求内容` string, _seq long")
    assert sorted(r.order_id for r in src.load_tickets(df).collect()) == ["AUTO_0", "AUTO_1"]


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8-sig"), ("b.csv", "gbk")):
        (tmp_path / name).write_bytes("编号,内容\n1,噪音很大\n".encode(encoding))
        df = src.read_tickets_csv(spark, str(tmp_path / name))
        assert df.columns == ["编号", "内容"] and df.first()["内容"] == "噪音很大"


def test_each_file_has_its_own_encoding(spark, tmp_path):
    texts = {"a b.csv": ("utf-8-sig", "噪音很大"), "b.csv": ("gbk", "垃圾清理"), "c.csv": ("gb18030", "𠮷路"), "d.csv": ("utf-8", "été"), "e.csv": ("iso-8859-1", "caf\xe9 \xff")}
    for n, (name, (encoding, text)) in enumerate(texts.items()):
        head = "编号,内容" if encoding not in ("iso-8859-1",) else "id,text"
        (tmp_path / name).write_bytes(f"{head}\n{n},{text}\n{n},\n".encode(encoding))
    (tmp_path / "f.csv").write_bytes(b"")
    df = src.read_tickets_csv(spark, str(tmp_path))
    assert df.columns == ["编号", "内容", "id", "text"]
    got = {(r["编号"] or r["id"]): (r["内容"] or r["text"]) for r in df.collect() if r["内容"] or r["text"]}
    assert got == {str(n): text for n, (_, text) in enumerate(texts.values())} and df.count() == 10


def test_results_begin_with_a_mark(spark, tickets, tmp_path):
    src.write_results_csv(tickets.select("order_id", "content").repartition(2), str(tmp_path / "r"))
    files = [p.read_bytes() for p in (tmp_path / "r").glob("part-*.csv")]
    assert files and all(f.startswith("\ufefforder_id,content\n".encode()) for f in files)
    assert src.read_tickets_csv(spark, str(tmp_path / "r")).columns == ["order_id", "content"]


def test_writers(spark, tickets, tmp_path):
    src.write_results_csv(tickets.select("order_id"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 10
    src.write_report(tickets, tickets, str(tmp_path / "p"), rows=3)
    assert spark.read.parquet(str(tmp_path / "p/tickets")).count() == 3
    calls = []
    pull = lambda: (calls.append(1), tickets)[1]
    for _ in range(2):
        assert src.read_parquet_cache(spark, str(tmp_path / "c"), pull).count() == 10
    assert len(calls) == 1


def test_groups_do_not_depend_on_row_order(tickets):
    a = grouping.event_subject_groups(tickets, subject=F.col("extracted_subject"))
    b = grouping.event_subject_groups(tickets.orderBy(F.desc("_seq")), subject=F.col("extracted_subject"))
    assert sorted(map(tuple, a.select("order_id", "cluster_id").collect())) == sorted(map(tuple, b.select("order_id", "cluster_id").collect()))
    ids = {r.order_id: r.cluster_id for r in a.collect()}
    assert ids["t0"] == 0 and ids["t1"] == 1 and ids["t9"] == -1 and ids["t6"] == 2


def test_all_titles_blank_uses_event_types(tickets):
    df = tickets.withColumns({"title": F.lit(" "), "extracted_event": F.when(F.col("_seq") < 5, "噪音").otherwise("")})
    ids = {r.order_id: r.cluster_id for r in grouping.event_subject_groups(df, subject=F.lit("")).collect()}
    assert {ids[f"t{i}"] for i in range(5)} == {0} and {ids[f"t{i}"] for i in range(5, 10)} == {-1}


def test_recurrence(spark):
    rows = [(i, -1 if i < 5 else 0 if i < 7 else 1, "a" if i % 2 else "b") for i in range(10)]
    df = spark.createDataFrame(rows, "_seq long, cluster_id long, v string").withColumns({f"extracted_{x}": F.col("v") for x in ("subject", "event", "area")})
    flags = {r.cluster_id: (r.is_multi_freq, r.cluster_size) for r in recurrence.classify_recurring(df).collect()}
    assert flags == {-1: (False, 5), 0: (False, 2), 1: (True, 3)}


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(0, v) for v in ("b", "a", "a", "b", "")], "k int, v string")
    assert recurrence.group_mode(df, "k", "v").first()["mode"] == "a"


def test_profiles(tickets):
    df = tickets.withColumn("cluster_id", F.lit(0).cast("long")).withColumn("extracted_subject", F.concat(F.lit("s"), F.col("_seq") % 3))
    e = recurrence.event_profiles(recurrence.classify_recurring(df)).first()
    assert (e.event_id, e.event_subject, e.frequency, len(e.sample_orders), e.first_seen) == ("EV001", "多主体聚合（3处）", 10, 8, "2025-03-01 08:30")
    assert e.dedup_metrics.span_days == "3 天" and e.dedup_metrics.freq_level == "高发" and e.dedup_metrics.subject_concentration == 40
    none = recurrence.event_profiles(recurrence.classify_recurring(df.withColumn("submit_time", F.lit(None).cast("timestamp")))).first()
    assert none.first_seen == "未知" and none.dedup_metrics.span_days == "未知"
    flagged = recurrence.classify_recurring(df).where("is_multi_freq").count()
    assert flagged == sum(r.frequency for r in recurrence.event_profiles(recurrence.classify_recurring(df)).collect())


def test_greedy_consolidation(spark):
    rows = [(0, "s", "A", 0), (1, "s", "", 1), (2, "s", "B", 2), (3, "s", "A", 3), (4, "t", "A", 4)]
    df = spark.createDataFrame(rows, "cluster_id long, extracted_subject string, extracted_event string, _seq long").withColumn("extracted_area", F.lit("x"))
    assert {r._seq: r.cluster_id for r in grouping.consolidate_subjects(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    blank_first = df.where("_seq in (1, 2, 3)")
    assert {r._seq: r.cluster_id for r in grouping.consolidate_subjects(blank_first).collect()} == {1: 1, 2: 1, 3: 1}


def test_verdict_chains_and_cycles(spark):
    df = spark.range(8).withColumnRenamed("id", "cluster_id")
    v = spark.createDataFrame([(3, 2, True, 0), (2, 1, True, 1), (5, 6, True, 2), (6, 5, True, 3), (7, 0, False, 4)], "small long, big long, same boolean, _seq long")
    out = grouping.merge_by_verdict(df.withColumn("k", F.col("cluster_id")), v)
    assert {r.k: r.cluster_id for r in out.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_pair_eval(spark):
    clusters = spark.createDataFrame([(f"i{i}", c) for i, c in enumerate((0, 0, 0, 1, 1, 2))], "order_id string, cluster_id long")
    gold = spark.createDataFrame([("i0", "i1", 1, "k"), ("i3", "i4", 1, "k"), ("i1", "i2", 0, "k"), ("i0", "i5", 1, "k"), ("i0", "zz", 1, "k")], "id_a string, id_b string, label int, category string")
    r = rollups.pair_eval(gold, clusters).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and round(r.f1, 4) == round(2 / 3, 4)
    assert [x.order_id for x in rollups.missing_gold(gold, clusters).collect()] == ["zz"]
    assert sorted(x.error for x in rollups.wrong_pairs(gold, clusters).collect()) == ["漏并", "误并"]


def test_same_place_is_exact(spark):
    values = list(itertools.product(["", "大良街道升平社区", "大良街道升平社区3栋", "顺德区"], ["", "升平社区"], ["", "3栋"], ["", "某某公司"]))
    rows = [(f"o{i:03}", *v, "大良街道") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "order_id string, addr_norm string, addr_community string, addr_building string, extracted_subject string, extracted_area string")
    found = {tuple(r) for r in related.same_place_pairs(df).collect()}
    places = related._places(df)
    brute = places.alias("a").crossJoin(places.alias("b")).where(F.col("a.order_id") < F.col("b.order_id")).where(related.same_place("a", "b"))
    assert found == {(r[0], r[1]) for r in brute.select("a.order_id", "b.order_id").collect()} and found
    both_districts = [r[0] for r in rows if r[1] == "顺德区" and r[2:5] == ("", "", "")]
    assert len(both_districts) == 1


def test_duplicates(spark):
    cols = "id int, v array<double>, organization string, address string, event_type string, request string, time_start string"
    rows = [(1, [1.0, 0.5], "o", "a", "e", "r", ""), (2, [1.0, 0.0], "o", "a", "x", "r", ""), (3, [1.0, 0.5], "o", "b", "e", "r", "")]
    df = spark.createDataFrame(rows, cols)
    got = {(r.a, r.b): (r.score, r.duplicate) for r in similarity.judge_duplicates(similarity.duplicate_candidates(df, "id", "v"), df, "id", close=2.0).collect()}
    assert got == {(1, 2): (0.7, True), (1, 3): (0.6, False), (2, 3): (0.4, False)}


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    v = np.concatenate([base, base + 0.1 * rng.normal(size=(40, 8)), base[:5]])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id int, v array<double>")
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if u[i] @ u[j] >= 0.9}
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, "id", "v", 0.9, max_pairs=None).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_density_is_components_for_two(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a int, b int")
    ids = spark.range(1, 8).select(F.col("id").cast("int").alias("id"))
    assert {r.id: r.cluster_id for r in similarity.density_cluster(ids, "id", pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: 5, 6: 5, 7: None}
    assert {r.id: r.cluster_id for r in similarity.density_cluster(ids, "id", pairs, 3).collect()} == {1: 2, 2: 2, 3: 2, 4: None, 5: None, 6: None, 7: None}


def test_request_groups(spark):
    rows = [(0, "请停止噪音。"), (1, "请停止噪音"), (2, "请停止噪音吧"), (3, "清理垃圾"), (4, "。")]
    df = spark.createDataFrame([(i, r, i) for i, r in rows], "id int, request string, _seq int")
    groups = sorted(r.ids for r in similarity.dedup_requests(df, "id", "request").collect())
    assert groups == [[0, 1, 2], [3], [4]]
    s = df.limit(1).select(similarity.request_similarity(F.lit("abcd"), F.lit("bcde")).alias("s")).first()["s"]
    assert s == 0.75
    assert sorted(r.ids for r in similarity.merge_same_person_request(df.withColumn("p", F.lit("x")), "id", "p", "request").collect()) == [[0, 1], [2], [3], [4]]


def test_search_is_literal(tickets):
    df = tickets.withColumns({"cluster_id": F.lit(0), "is_multi_freq": F.lit(True), "cluster_size": F.lit(10)})
    assert search.search_orders(df, q="内容[").count() == 0 and search.search_orders(df, q="内容3").count() == 1
    events = df.limit(0).select(F.lit("EV001").alias("event_id"), "cluster_id", F.lit("x").alias("event_type"), F.lit(1).alias("frequency"))
    assert search.search_orders(df, event="EV001", events=events).count() == 0
    page, total = search.orders_page(df, events, page=0, size=4)
    assert page.count() == 4 and total.first()["total"] == 10


def test_quality_gate_falls_back(tickets):
    df = tickets.withColumn("cluster_id", F.lit(-1).cast("long"))
    out, good = grouping.quality_gate(df)
    assert not good and grouping.coverage(out).first()["coverage"] == 1.0


def test_svd(spark):
    from ticketspark.functions.text import char_ngrams

    df = spark.createDataFrame([(0, "停车难"), (1, "停车很难"), (2, "垃圾多"), (3, "")], "id long, text string")
    v = {r.id: r.vector for r in similarity.svd_embed(df, "id", char_ngrams(F.col("text")), 2).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot(0, 1) > 0.9 > dot(0, 2) and set(v[3]) == {0.0}


def test_svd_against_numpy(spark):
    rng = random.Random(10)
    kinds = [[f"w{rng.randrange(300)}" for _ in range(25)] for _ in range(6)]
    rows = [(i, " ".join(rng.choices(kinds[i % 6], k=20) + [f"w{rng.randrange(300)}" for _ in range(6)])) for i in range(90)] + [(90, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    terms, weights = {}, {}
    for r in similarity.tfidf(df, "id", tokens).collect():
        weights[r.id, terms.setdefault(r.term, len(terms))] = r.w
    a = np.zeros((91, len(terms)))
    for at, w in weights.items():
        a[at] = w
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :5] * s[:5]
    want /= np.maximum(1e-12, np.linalg.norm(want, axis=1, keepdims=True))
    got = np.array([r.vector for r in similarity.svd_embed(df, "id", tokens, 5, width=1 << 16, rounds=12).orderBy("id").collect()])
    assert got.shape == (91, 5) and np.abs(got @ got.T - want @ want.T)[:90, :90].max() < 0.02 and not got[90].any()


def test_places_of_many_addresses(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    addr = lambda: pick("", "顺德区", "升平社区", "大良街道升平社区") + pick("", "延年路", "凤翔大道12号", "凤翔大道7号", "东苑市场") + pick("", "3栋", "12号")
    rows = [(f"o{i:03}", addr(), pick("", "升平社区", "南国社区"), pick("", "3栋", "5座"), pick("", "恒达装饰公司", "某店"), pick("大良街道", "容桂街道")) for i in range(160)]
    df = spark.createDataFrame(rows, "order_id string, addr_norm string, addr_community string, addr_building string, extracted_subject string, extracted_area string")
    found = {tuple(r) for r in related.same_place_pairs(df).collect()}
    p = related._places(df)
    brute = p.alias("a").join(p.alias("b"), F.col("a.order_id") < F.col("b.order_id")).where(related.same_place("a", "b"))
    want = {(r[0], r[1]) for r in brute.select("a.order_id", "b.order_id").collect()}
    assert found == want and len(want) > 1000
    times = df.withColumn("submit_time", F.lit(None).cast("timestamp"))
    mates = {r.order_id for r in related.related_to(related.place_members(df), times, "o007").collect()}
    assert mates == {b if a == "o007" else a for a, b in want if "o007" in (a, b)}
    assert related.place_members(df.limit(0)).count() == 0


def test_likely_duplicates_lose_none(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random(), 1.0], *(rng.choice(x) for x in (["", "o", "p"], ["", "a", "b"], ["e", "f"], ["", "r"], [None, "t"]))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, v array<double>, organization string, address string, event_type string, request string, time_start string")
    judged = lambda pairs: {(r.a, r.b) for r in similarity.judge_duplicates(pairs, df, "id").where("duplicate").collect()}
    few, many = similarity.likely_duplicates(df, "id", "v"), similarity.duplicate_candidates(df, "id", "v")
    assert judged(few) == judged(many) != set() and few.count() < many.count()


def test_sparse_pairs_against_all(spark):
    rng = random.Random(7)
    vectors = {i: {rng.choice("abcdefghij") if rng.random() < 0.6 else f"t{rng.randrange(60)}": rng.random() + 0.1 for _ in range(rng.randrange(1, 9))} for i in range(120)}
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vectors.items()}
    df = spark.createDataFrame([(i, t, w / norm[i]) for i, v in vectors.items() for t, w in v.items()], "id int, term string, w double")
    for least in (0.2, 0.5, 0.9):
        want = {(a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) / norm[a] / norm[b] >= least}
        assert {(r.a, r.b) for r in similarity.sparse_pairs(df, least).collect()} == want


def test_recall_of_similar_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.855 * base + (1 - 0.855**2) ** 0.5 * away
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((base, near, base[:3], base[:3], base[:3])))] + [(900, []), (901, None)]
    pairs = similarity.similar_pairs(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 0.85, max_pairs=None).collect()
    got = {(r.a, r.b) for r in pairs}
    assert sum((i, i + 300) in got for i in range(300)) >= 0.97 * 300
    copies = [0, 600, 603, 606]
    assert all((a, b) in got for a in copies for b in copies if a < b)
    two = similarity.similar_pairs(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 0.85, top_k=2, max_pairs=None).collect()
    best = lambda x: sorted(((-r.similarity, r.a, r.b) for r in pairs if x in (r.a, r.b)))[:2]
    assert {(r.a, r.b) for r in two} == {(a, b) for x in range(609) for _, a, b in best(x)}


def test_leaders_of_requests_against_a_plain_loop(spark):
    from difflib import SequenceMatcher

    rng = random.Random(9)
    base = ["退款", "请求退款处理", "refund the order", "repair street lamp", "x", "夜间噪音扰民请处理", "ab"]
    texts = []
    for _ in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = rng.choice(["a", "退", "e ", "", "处理"])
        texts.append("".join(w))
    rows = [(i, t, i * 7 % 250) for i, t in enumerate(texts)] + [(900, None, 900), (901, " ", 901)]
    df = spark.createDataFrame(rows, "id int, request string, _seq long")
    plain = {r.id: r.v for r in df.select("id", similarity.normalize_request(F.coalesce("request", F.lit(""))).alias("v")).collect()}
    for threshold in (0.85, 0.95):
        heads, of = [], {}
        for i, _, _ in sorted(rows, key=lambda r: r[2]):
            v = plain[i]
            if v == "":
                of[i] = f"#{i}"
            elif v not in of:
                fits = lambda h: 0.9 >= threshold if v in h or h in v else SequenceMatcher(None, h, v).ratio() >= threshold  # noqa: B023, E731
                of[v] = next((h for h in heads if fits(h)), v)
                if of[v] == v:
                    heads.append(v)
        want = {}
        for i, _, _ in rows:
            want.setdefault(of[i] if plain[i] == "" else of[plain[i]], []).append(i)
        got = {r.leader: r.ids for r in similarity.dedup_requests(df, "id", "request", threshold).collect()}
        assert got == {k: sorted(v) for k, v in want.items()} and len(heads) > 20


def test_svd_counts_terms_in_their_rows(spark, monkeypatch):
    from ticketspark.functions.text import char_ngrams

    texts = [("停车难停车", "垃圾多", "停车很难", "", None, "ab ba", "ab")[i % 7] for i in range(70)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    rows = {r.id: dict(zip(r.cols, r.ws, strict=True)) for r in similarity._hashed_terms(df, "id", char_ngrams(F.col("text")), 1 << 16).collect()}
    want = {}
    for r in similarity.tfidf(df, "id", char_ngrams(F.col("text"))).select("id", F.pmod(F.xxhash64("term"), F.lit(1 << 16)).alias("col"), "w").collect():
        want.setdefault(r.id, {}).setdefault(r.col, []).append(r.w)
    assert set(rows) == set(range(70)) and all({c: pytest.approx(sum(w)) for c, w in want.get(i, {}).items()} == rows[i] for i in rows)
    # with more terms than tasks may know, the join gives the same
    monkeypatch.setattr(similarity, "VOCABULARY", 2)
    joined = {r.id: dict(zip(r.cols, r.ws, strict=True)) for r in similarity._hashed_terms(df, "id", char_ngrams(F.col("text")), 1 << 16).collect()}
    assert all(joined[i] == pytest.approx(rows[i]) for i in rows)


def test_text_tokens_are_the_terms_of_char_ngrams(spark):
    from ticketspark.functions.text import char_ngrams

    df = spark.createDataFrame([(t,) for t in ("停车 X1!é𝄞a街道b", "ÀB c\nde..", "", None, "7")], "t string")
    for r in df.select(F.sort_array(similarity.text_tokens(F.col("t"))).alias("a"), F.sort_array(char_ngrams(F.coalesce("t", F.lit("")))).alias("b")).collect():
        assert r.a == r.b


def test_pairs_at_several_places_come_once_without_a_shuffle_of_pairs(spark):
    rng = random.Random(8)
    rows = [(f"o{i}", f"p{rng.randrange(4)}", rng.random() < 0.5) for i in range(60) for _ in range(3)]
    members = spark.createDataFrame(rows, "order_id string, place string, core boolean")
    want = {(min(a, b), max(a, b)) for a, p, x in rows for b, q, y in rows if a != b and p == q and (x or y)}
    for tile in (1000, 7):
        out = related._pairs_once(members, tile)
        got = [tuple(r) for r in out.collect()]
        assert set(got) == want and len(got) == len(want)
    # the join is the last step: nothing is grouped or dealt after it
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Repartition") and "Aggregate" not in plan
