import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketspark.llm import chat, decontamination, language_id, near_duplicates, packing, pii, substring_dedup, topk, toxicity, url_filter

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \t\n", "x", "Ünï çödé", "a b", "  a   b ", "the\x0bsame", "z" * 5000]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def corpus(seed=1, groups=12, n=160, vocabulary=60):
    """Texts with exact and near copies, odd ones, nulls and a repeated row; ids in mixed order."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd Ef gh ij kl mn op qr st".split()) + str(rng.randrange(vocabulary))
    base = [[word() for _ in range(rng.choice([3, 14, 40, 90]))] for _ in range(groups)]
    passage = [word() for _ in range(20)]
    texts = list(ODD)
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at] = passage
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    ids = rng.sample(range(1000), len(texts))
    return [*zip(ids, texts, strict=True), (ids[-1], texts[-1]), (None, texts[-1])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "junk", 7) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, n long")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, key string, held_out boolean")


@pytest.mark.parametrize(("size", "tile"), [(2, 2048), (5, 2048), (2, 1)])
def test_near_duplicates_against_all_pairs(docs, size, tile):
    sets = {}
    for i, t in {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}:
        w = SPLIT.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = near_duplicates.near_duplicates(docs, near_duplicates.Plan(shingle=size, tile=tile)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert len({find(i) for i in sets}) < len(sets)


@pytest.mark.parametrize("settings", [{}, {"tile": 50}])
def test_near_duplicates_in_a_crowd_around_one_passage(spark, settings):
    # 1,200 documents share 60 of 68 shingles with each other, at 0.79, and lie in common buckets; every twelfth has a twin at 0.81 and over
    rng = random.Random(8)
    shared = [f"common{i}" for i in range(61)]
    rows = {i: [*shared, *(f"own{i}-{j}" for j in range(9))] for i in range(1200)}
    for i in range(0, 1200, 12):
        rows[2000 + i] = [*rows[i][:-1], f"twin{i}"]
    order = list(rows)
    rng.shuffle(order)
    df = spark.createDataFrame([(i, " ".join(rows[i])) for i in order], "doc_id long, text string")
    got = near_duplicates.near_duplicates(df, near_duplicates.Plan(shingle=2, **settings)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 2000 if i >= 2000 else i for i in rows}


def test_near_duplicates_of_a_chain_and_of_nothing(spark, none):
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 40])) for i in range(11)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_duplicates.Plan(shingle=2)).collect()
    assert {r.component_id for r in got} == {0}  # neighbours share 35 of 43 shingles, ends none
    assert near_duplicates.near_duplicates(none).count() == 0


def test_sketch_bounds_hold():
    rng = np.random.default_rng(5)
    plan = near_duplicates.Plan()
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, 600, replace=False)) for _ in range(6)] + [np.unique(pool[:500]), np.unique(pool[20:520])]
    keys, marks = near_duplicates.signatures(sets, plan)
    for i, j in itertools.combinations(range(len(sets)), 2):
        odd = np.unpackbits((marks[i] ^ marks[j]).view(np.uint8)).reshape(2, -1).sum(1)
        assert odd[1] <= len(np.setxor1d(sets[i], sets[j]))
    assert (keys[6] == keys[7]).any()


def test_pairs_just_over_the_similarity_pass_bands_and_sketches():
    rng = np.random.default_rng(21)
    plan = near_duplicates.Plan()
    lost = one_band = 0
    for n in [40, 90, 200, 1000] * 100:
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))[:n]
        gone = int(n * 0.19) // 2  # 0.81 in common, or a little more
        (kx, ky), (x, y) = near_duplicates.signatures([np.sort(pool[: n - gone]), np.sort(pool[gone:])], plan)
        shared = (kx == ky).sum()
        odd = np.unpackbits((x ^ y).view(np.uint8)).reshape(2, -1).sum(1)
        guess = 1 + plan.sketch_bits / (4 * plan.samples) * np.log(max(1e-9, 1 - 2 * odd[0] / plan.sketch_bits))
        lost += shared == 0 or guess < plan.sketch_floor or 180 * odd[1] > 20 * 2 * (n - gone)
        one_band += shared < 2
    assert lost == 0 and one_band <= 1


@pytest.mark.parametrize("bounds", [{}, {"count_bytes": 3 * 256 * 8}])
def test_top_k_against_all_pairs(spark, bounds):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 6)).round(1)
    v[30:90] = v[3]  # many equal scores
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [0.5]), (905, []), (920, []), (None, rows[0][1]), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0 or vec_id = 904"), 20, **bounds).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in rows if i is not None and i < 900]
    for q in range(0, 150, 20):
        own = dict(ints)[q]
        best = sorted(((-int(own @ x), i) for i, x in ints if i != q))[:20]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(got) == set(range(0, 150, 20))  # 904 has no vector of its length
    few = topk.exact_top_k(df.where("vec_id < 5"), df.where("vec_id < 2"), 20)
    assert few.count() == 8 and topk.exact_top_k(df.limit(0), df.limit(0), 20).count() == 0


def test_chats_round_trip(spark, sha):
    texts = ["hi", None, "", "<|im_end|>", "<!|x|>", "a<", "|b", "<|im_next|><!!|", "line\nline", "\\ <"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem<|im_start|>", None]), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (1, None, "user", "first"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))})
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = [(role, text) for _, _, role, text in sorted(turns)]
        assert [tuple(t) for t in got[c].turns] == said
        assert got[c].loss == "".join(text for role, text in said if role == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len([k for k, _ in itertools.groupby(said, key=lambda x: x[0])])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language_id(spark, none):
    rng = random.Random(3)
    parts = {"xx": ["ba", "bo", "bi", "ku"], "yy": ["sch", "ung", "ein", "pf"], "zz": ["élé", "aux", "oi", "eau"]}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(3))
    rows = [(i, " ".join(word(x) for _ in range(rng.choice([4, 30]))), x) for i, x in enumerate(rng.choices(list(parts), k=300))]
    df = spark.createDataFrame([(str(i), t, x) for i, t, x in rows], "key string, text string, lang string")
    model = language_id.fit(df.where("key % 3 <> 1"))
    assert sorted(model.languages) == sorted(parts)
    asked = spark.createDataFrame([*rows, *((1000 + i, t, None) for i, t in enumerate(ODD)), (2000, "123 !?", "xx"), rows[0]], "doc_id long, text string, lang_pred string").withColumn("score", F.lit("old"))
    out = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert len(language_id.predict(asked, model).columns) == 4
    assert sum(out[i].lang_pred == x for i, _, x in rows) >= 297
    assert out[1000].lang_pred == out[1001].lang_pred == out[2000].lang_pred == "und" and out[1003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = language_id.fit(none.select("key", "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(asked, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_filter_holds_all_it_was_given():
    codes = np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64)
    languages = [f"l{i}" for i in range(70)]  # more than one plane of bits
    which = np.arange(5000) % 70
    f = language_id.Filter.build(languages, codes, which)
    planes = f.known(codes)
    assert all((planes[i // 64][which == i] >> np.uint64(i % 64) & np.uint64(1)).all() for i in range(70))
    assert f.false_rate.max() < 0.02


@pytest.mark.parametrize(("window", "sizes"), [(13, {}), (5, {}), (2, {}), (5, {"bucket_bytes": 500, "coarse": 3})])
def test_repeats_against_all_windows(docs, sha, window, sizes):
    rows = [(r.doc_id, SPLIT.findall(r.text or "")) for r in docs.collect()]
    owner = {}
    for i, w in rows:
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                owner[key] = min(i, owner.get(key, i))
    want = Counter()
    for i, w in rows:
        gone = {k for j in range(len(w) - window + 1) if i is not None and owner[tuple(w[j : j + window])] < i for k in range(j, j + window)}
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, window, **sizes).collect())
    assert got == want and (window == 2 or sum(k[2] for k in got))
    digests = {r.kept for r in substring_dedup.remove_repeats(docs, window, give_text=False).collect()}
    assert digests == {sha(k[3]) for k in want}


def test_repeats_of_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == 0


def test_covers_have_their_property():
    for period, cover in substring_dedup.COVERS.items():
        for i, j in itertools.product(range(period), repeat=2):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_automaton_finds_words_within_the_edits():
    rng = random.Random(6)
    trie = toxicity.FuzzyTrie(["idiot", "ass", "disgusting"], ["lowe", "abcdef"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def expected(w):
        out = [d for t in ("idiot", "ass", "disgusting") if (d := distance(w, t)) <= toxicity.edits_allowed(t, False)]
        for s in ("lowe", "abcdef"):
            out += [d for n in range(len(w) + 1) if (d := distance(w[:n], s)) <= toxicity.edits_allowed(s, True)]
        return min(out, default=9)

    words = ["idiot", "id1ot", "idiots", "iidiot", "idit", "ass", "as", "disgsting", "disgustng", "dsgustin", "lowei", "lowx", "abcdefgh", "abcxdefgh", "abcefgh", ""]
    words += ["".join(rng.choice("idotasbclw") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    assert [trie.distance(w) for w in words] == [expected(w) for w in words]


def test_toxicity(spark, none):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ru", "sa", "ti", "vo", "wex")]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(20)]
        toxic = i % 5 == 0
        if toxic:
            for bad in rng.sample(["idiot", "scum", "worthless"], 2):
                w[rng.randrange(20)] = bad
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in enumerate(ODD))], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), labels[0]], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 4 <> 2"), marks)
    assert {"idiot", "scum", "worthless"} <= set(model.words) and not model.stems
    out = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", F.lit(True).alias("held_out"), "text"), model).collect()}
    assert sum((out[i] >= 0.3) == bool(t) for i, t in labels) >= 398 and all(0 <= s <= 1 for s in out.values())
    empty = toxicity.fit(none, marks)
    assert not empty.words and toxicity.score(none.select("doc_id", "held_out", "text"), model).count() == 0


def test_pseudonyms(spark):
    rows = ["call +1 (523) 555-1055 or 523-555-1055", "4111111111111111 and 4111-1111-1111-1111, not 4111111111111112", "on 2024-02-29, 29.02.2024, 02/29/2024, not 31.02.2024 or 2024-1.2", "a.Bc9@Example.com, A.bC9@example.com.", "10.0.0.1 not 10.0.0.256 or 1.2.3.4.5", "123-45-6789 not 666-45-6789", None, "", "plain 12 text 2024"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"n_pii": F.lit("x"), "lang": F.lit(None).cast("string")})
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert [got[i].n_pii for i in range(9)] == [2, 2, 3, 2, 1, 1, 0, 0, 0]
    assert got[6].text is None and got[7].text == "" and got[8].text == rows[8]
    digits = lambda s: re.sub(r"\D", "", s)
    a, b = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", got[0].text)
    assert digits(a) == digits(b) and a[0] == "(" and digits(a) != "5235551055"
    x, y, kept = re.findall(r"[\d-]{16,}", got[1].text)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(s)))) % 10 == 0
    assert digits(x) == digits(y) != "4111111111111111" and luhn(x) and kept == "4111111111111112"
    p, q, r, bad = re.findall(r"\d+[-./]\d+[-./]\d+", got[2].text)[:4]
    assert p == "-".join(reversed(q.split("."))) and bad == "31.02.2024" and p != "2024-02-29"
    m, d, year = r.split("/")
    assert f"{year}-{m}-{d}" == p
    e, f = re.findall(r"[\w.]+@[\w.]+\w", got[3].text)
    assert e.lower() == f.lower() and re.fullmatch(r"[a-z]\.[A-Z][a-z]\d@Example\.com", e)
    assert pii.pseudonymise(df.limit(0), "key").count() == 0


def test_permutation_is_one_to_one(spark):
    ids = spark.range(1000).select(F.col("id"), pii._permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "t", "k").alias("p"), pii.feistel(F.col("id") % 27, F.floor(F.col("id") / 27), F.lit(27), F.lit(38), F.lit("t"), "k").alias("f"))
    out = ids.where("id < 1000").collect()
    assert len({r.p for r in out}) == 1000 and len({tuple(r.f) for r in out}) == 1000


@pytest.mark.parametrize("automaton_bytes", [1 << 24, 60])
def test_contamination_against_all_windows(spark, docs, automaton_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "b c"), (2, rows[20][1]), (3, rows[40][1]), (10, (rows[60][1] or "")[:80]), (4, None), (5, "?!"), (None, "a b"), (6, "X"), (2, rows[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for j in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[j : j + 10])].add(i)
    want = Counter()
    for i, t in rows:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for x, owners in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    found |= owners
        want[(i, len(w), tuple(sorted(hit)), tuple(sorted(found)))] += 1
    out = decontamination.find_contamination(docs, bench, 10, automaton_bytes).collect()
    assert Counter((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r.item_ids)) for r in out) == want
    for r in out:
        text = next(t for i, t in rows if i == r.doc_id and len(word.findall(lower(t or ""))) == r.n_words) or ""
        found = [w for s in r.spans for w in word.findall(lower(text.encode()[s.first : s.last].decode()))]
        assert found == [word.findall(lower(text))[k] for k in r.hit_words]
    clean = decontamination.drop_contaminated(docs, bench, 10, automaton_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontamination.find_contamination(docs, bench.limit(0)).where("size(hit_words) > 0").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_matcher_finds_every_window():
    rng = random.Random(17)
    texts = [[rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 11, 40]))] for _ in range(60)]
    docs = [[rng.choice("abcdefgxy") for _ in range(40)] for _ in range(60)] + [t[:] for t in texts[::3]] + [["x", *t, "y"] for t in texts[1::3]]
    for size in (1, 2, 3, 4, 6):
        matcher = decontamination.Matcher([(i, " ".join(t)) for i, t in enumerate(texts)], size)
        windows = defaultdict(set)
        for i, t in enumerate(texts):
            for j in range(max(1, len(t) - size + 1)):
                windows[tuple(t[j : j + size])].add(i)
        for d in docs:
            want = {(j, j + len(w)): owners for w, owners in windows.items() for j in range(len(d) - len(w) + 1) if tuple(d[j : j + len(w)]) == w}
            found, items = matcher.find([x.encode() for x in d])
            assert set(found) == set(want) and items == set().union(*want.values())


def test_automaton_needs_three_nodes_for_each_word():
    rng = random.Random(18)
    text = " ".join(f"w{rng.randrange(30_000)}" for _ in range(100_000))
    matcher = decontamination.Matcher([(1, text)], 10)
    assert matcher.automaton.get_stats()["nodes_count"] <= 300_001 and len(matcher.codes) == len(set(text.split()))


def test_cascade_is_exact():
    rng = np.random.default_rng(9)
    h1, h2 = rng.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64)
    for share in (0, 0.01, 0.5, 1):
        listed = rng.random(20_000) < share
        levels = url_filter.build_levels(h1, h2, listed)
        assert (url_filter.is_listed(levels, h1, h2) == listed).all()


@pytest.mark.parametrize(("shard_keys", "broadcast_bytes"), [(1 << 18, 1 << 24), (7, 100)])
def test_cascade_in_shards(spark, shard_keys, broadcast_bytes):
    keys = spark.range(60).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade, shards = url_filter.build_cascade(keys, shard_keys)
    rows = keys.select("key", F.lit(1).alias("extra")).union(keys.limit(5).select("key", F.lit(2)))
    out = url_filter.look_up(rows, "key", cascade, shards, broadcast_bytes).collect()
    assert len(out) == 65 and all(r.in_list == (int(r.key[1:]) % 3 == 0) for r in out)


def test_urls(spark):
    urls = ["http://a.example.org/es/x?q#f", "HTTP://Example.ORG/en/12", "http://example.org", "no scheme", None, "", "x://com/fr/", "http://b.com/de/1", "http://badexample.org/es/", "http://spam-farm.net/?://x/fr/", "http://net/\nx"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam-farm.net",), ("spam-farm.net",), (None,), ("nowhere.net",), ("net",), ("example.org",)], "host string").where("host <> 'net'")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.RULES, listed).collect()}
    assert out == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "", None, "block"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("com", "/fr/", "com/fr/", "allow"), 7: ("b.com", "/de/1", "com/de/", "block"),
        8: ("badexample.org", "/es/", "org/", "allow"), 9: ("spam-farm.net", "/", None, "block"), 10: ("net", "/\nx", None, "allow"),
    }
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES, listed).count() == 0
    long = "x://spam-farm.net/" + "a" * 100_000
    again = df.union(df).union(spark.createDataFrame([(50, long, "h"), (None, long, "h")], df.schema))
    rows = url_filter.judge_urls(again, url_filter.RULES, listed.limit(1)).collect()
    assert len(rows) == 24 and sum(r.path == long[17:] and r.verdict == "block" for r in rows) == 2
    assert {r.verdict for r in url_filter.judge_urls(df, [], listed.limit(0)).collect()} == {"allow"}
    assert {r.host for r in url_filter.hosts_with_labels(df, ["spam-farm", "b"]).collect()} == {"spam-farm.net", "b.com"}


def test_boundaries_against_all_choices():
    rng = np.random.default_rng(7)
    for _ in range(40):
        lengths = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        counts = rng.integers(1, 20, len(lengths))
        for k in (1, 2, 3, 20):
            cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
            best = min(cost([*some, lengths[-1]]) for m in range(min(k, len(lengths))) for some in itertools.combinations(lengths[:-1], m))
            ends = packing.best_boundaries(lengths, counts, k)
            assert len(ends) <= k and cost(ends) == best
    assert packing.best_boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 3, 10, 10, 55, 99, 100, 101, 5000])) for i in range(500)] + [(7, 10), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("slot", F.lit("x"))
    out = packing.pack(df, "n", 100, 3).collect()
    assert len(out) == len(rows)
    batches = defaultdict(list)
    for r in out:
        assert r.bucket_len >= (r.n or 0) and r.padding == r.bucket_len - (r.n or 0)
        batches[(r.bucket, r.batch)].append(r)
    for (bucket, _), rs in batches.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or sum(r.bucket_len for r in rs) <= 100
        assert bucket == 3 or rs[0].bucket_len <= 100
    for b in {k[0] for k in batches} - {3}:
        numbers = sorted(n for k, n in batches if k == b)
        capacity = 100 // max(1, batches[(b, 0)][0].bucket_len)
        assert numbers == list(range(len(numbers))) and all(len(batches[(b, n)]) == capacity for n in numbers[:-1])
    assert packing.pack(df.limit(0), "n", 100, 3).count() == 0
    assert {r.n: r.c for r in spark.createDataFrame([(1, " a  b\n"), (0, ""), (3, None)], "n int, t string").select("n", packing.count_words(F.col("t")).alias("c")).collect()} == {1: 2, 0: 0, 3: 0}


def test_pseudonyms_of_marked_phones_cards_beside_numbers_and_timestamps(spark):
    rows = [
        "+1 (017) 555-7713 or +1 017-555-7713, (136) 555-7479, +15235551055; not 017-555-7713",
        "4111 1111 1111 1111 05/27",
        "order 12 4111 1111 1111 1111 and 1234-4111-1111-1111-1111-05",
        "4111 1111 1111 1111 523-555-1055 2024-03-05, 4111111111111111 123",
        "at 2024-03-05T10:00 and 2024-03-05 10:00, not 2024-03-05Tx",
        "12 34 5678 9012 3456 7890, 3782 822463 10005 1",
    ]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    n = [r.n_pii for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    assert n == [4, 1, 2, 4, 2, 1]
    digits = lambda s: re.sub(r"\D", "", s)
    a, b, c, d = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3}-\d{3}-\d{4}), (\(\d{3}\) \d{3}-\d{4}), (\+1\d{10}); not 017-555-7713", got[0]).groups()
    assert digits(a) == digits(b) != "10175557713" and digits(a)[1] in "01" and c[1] in "01" and c != "(136) 555-7479" and d[2] not in "01"
    card = got[1][:19]
    assert re.fullmatch(r"\d{4}( \d{4}){3}", card) and card != rows[1][:19] and got[1][19:] == " 05/27"
    assert got[2] == f"order 12 {card} and 1234-{card.replace(' ', '-')}-05"
    assert got[3].startswith(card + " ") and got[3].endswith(f", {digits(card)} 123") and "523-555-1055" not in got[3] and "2024-03-05" not in got[3]
    day = got[4][3:13]
    assert day != "2024-03-05" and got[4] == f"at {day}T10:00 and {day} 10:00, not 2024-03-05Tx"
    assert got[5].startswith("12 34 5678 9012 3456 7890, ") and got[5].endswith(" 1") and "822463" not in got[5]


def test_addresses_of_other_letters_and_phones_with_extensions(spark):
    names = ["müller", "MÜLLER", "joão.silva", "łukasz", "Ærø", "ßa", "иван.петров", "Иван", "νίκος", "אבגד", "محمد", "mu\u0308ller", "a1é"]
    phones = ["+1-523-555-1055x12", "(523) 555-1055 ext. 12", "523-555-1055ext 7", "+44 20 7946 0958x4"]
    rows = [*(f"an {x}@beispiel.de, und" for x in names), *phones, "请联系zhang@example.com吧", "x@почта.рф", "523-555-1055xy 523-555-1055x1234567"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    n = [r.n_pii for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    assert n == [1] * (len(rows) - 1) + [0] and got[-1] == rows[-1]
    for name, text in zip(names, got, strict=False):
        new = re.fullmatch("an (.*)@beispiel.de, und", text)[1]
        assert len(new) == len(name) and new != name
        moved = [a for a, b in zip(name, new, strict=True) if a != b]
        assert all(b.isalnum() == a.isalnum() for a, b in zip(name, new, strict=True)) and len(moved) * 2 >= len(name)
    assert got[0].lower() == got[1].lower()
    for was, text in zip(phones, got[len(names) :], strict=False):
        cut = was.index("x") if "ext" not in was else was.index("ext")
        assert text[cut:] == was[cut:] and text[:cut] != was[:cut] and re.sub(r"\d", "", text) == re.sub(r"\d", "", was)
    assert got[-3].startswith("请联系") and got[-3].endswith("@example.com吧") and "zhang" not in got[-3]
    assert got[-2].endswith("@почта.рф")


def test_letters_of_addresses_move_one_to_one(spark):
    letters = sorted({chr(first + i * step) for first, k, step in pii.LETTERS for i in range(k)})
    assert all(x.isalpha() for x in letters)
    rows = [f"{a}{b}@x.de" for a in letters[::7] for b in letters[::11]]
    out = {r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "key").collect()}
    assert len(out) == len(rows)


VALID = ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "523-555-1055", "(523) 555-1055", "523.555.1055", "+1 (017) 555-7713", "+44 20 7946 0958", "123-45-6789", "2024-02-29", "29.02.2024", "21/02/2025", "10.0.0.1", "a.b9@example.com", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
OTHER = ["5235551055", "2024", "12", "4111111111111112", "10.0.0.256", "000-45-6789", "31.02.2024", "DE88370400440532013000", "x1y2"]


def test_valid_numbers_are_found_beside_any_others(spark):
    """Each alone has a pseudonym; two beside each other have the same ones, and other numbers stay."""
    texts = [*VALID, *OTHER]
    beside = [(a, b, sep) for a in texts for b in texts for sep in (", ", " ") if sep == ", " or not (a[-1].isdigit() and b[0].isdigit() and a in OTHER and b in OTHER)]
    df = spark.createDataFrame(list(enumerate([*texts, *(a + sep + b for a, b, sep in beside)])), "doc_id long, text string").repartition(8)
    got = [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    alone = dict(zip(texts, got, strict=False))
    assert all(alone[x] != x for x in VALID) and all(alone[x] == x for x in OTHER)
    wrong = [(a + sep + b, x) for (a, b, sep), x in zip(beside, got[len(texts) :], strict=True) if x != alone[a] + sep + alone[b]]
    assert not wrong


def test_slashed_dates_move_one_to_one(spark):
    days = spark.range(3000).select(F.date_add(F.lit("2019-11-05").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = F.array(F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "MM/dd/yyyy"), F.date_format("d", "yyyy-MM-dd"))
    df = days.select("d", F.posexplode(forms).alias("form", "text"), F.col("d").cast("string").alias("doc_id")).where("form <> 0 or day(d) > 12")
    rows = pii.pseudonymise(df, "k").collect()
    assert len({r.text for r in rows}) == len(rows) and all(r.n_pii == 1 for r in rows)
    day = lambda t, form: t if form == 2 else "-".join(t.split("/")[i] for i in ((2, 1, 0) if form == 0 else (2, 0, 1)))
    assert all(len(x) == 1 for x in [{day(r.text, r.form) for r in rows if r.d == d} for d in sorted({r.d for r in rows})[:200]])


def test_ibans_and_foreign_numbers_stay_valid(spark):
    rows = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "+44 20 7946 0958", "+442079460958"]
    a, b, c, d, e = (r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "key").orderBy("doc_id").collect())
    assert a == b.replace(" ", "") != rows[0] and c.startswith("GB") and " WEST " in c and d.replace(" ", "") == e != rows[4] and d.startswith("+44 ")
    rest = lambda x: int("".join(str(int(ch, 36)) for ch in x.replace(" ", "")[4:] + x[:4])) % 97
    assert rest(a) == rest(c) == 1


def test_pseudonyms_of_repeated_and_long_texts_and_keys(spark):
    long = "call 523-555-1055 " + "words and 12 more " * 20_000 + "or 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, long), (1, long), (None, "523-555-1055")], "doc_id long, text string")
    out = pii.pseudonymise(df, pii.session_key(spark)).collect()
    assert pii.session_key(spark) == spark.conf.get(pii.KEY_SETTING) and [r.n_pii for r in out] == [2, 2, 1] and out[0] == out[1]
    assert out[0].text[5:17] == out[2].text and len(out[0].text) == len(long)
    assert pii.pseudonymise(df, "other").collect()[2].text != out[2].text


def test_low_area_codes_move_one_to_one(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("+1 ("), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(") 555-0000")).alias("text"))
    assert len({r.text for r in pii.pseudonymise(df, "key").collect()}) == 200


def test_boundaries_of_many_lengths_are_those_of_the_plain_recurrence():
    def plain(lengths, counts, buckets):
        n, rows, tokens = len(lengths), np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(lengths * counts)))
        cost, back = np.concatenate(([0], lengths * rows[1:] - tokens[1:])), [np.zeros(n + 1, int)]
        for _ in range(1, min(buckets, n)):
            after, cut = cost.copy(), np.zeros(n + 1, int)
            for j in range(1, n + 1):
                total = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
                cut[j], after[j] = total.argmin(), total.min()
            cost = after
            back.append(cut)
        ends, j = [], n
        for cut in reversed(back):
            if j:
                ends.append(int(lengths[j - 1]))
                j = cut[j]
        return ends[::-1]

    rng = np.random.default_rng(11)
    for top, most, k in [(12, 3, 4)] * 200 + [(300, 2, 6)] * 20 + [(20_000, 50, 16)] * 3:
        lengths = np.unique(rng.integers(0, top, min(top, 1500)))[:: rng.integers(1, 4)]
        counts = rng.integers(1, most, len(lengths))
        assert packing.best_boundaries(lengths, counts, k) == plain(lengths, counts, k)


def test_a_long_row_does_not_coarsen_the_buckets(spark):
    rows = [(i, 1 + i % 50) for i in range(500)] + [(900, 8705)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), "n", 16_384, 51).collect()
    assert len(out) == len(rows) and sum(r.padding for r in out) == 0 and {r.bucket_len for r in out} == {n for _, n in rows}


def test_rare_kinds_of_abuse_get_terms(spark):
    rng = random.Random(12)
    text = lambda bad: " ".join([*(f"w{rng.randrange(4000)}" for _ in range(12)), bad, *(f"w{rng.randrange(4000)}" for _ in range(12))])
    rows = [(i, text("canalla" if i < 9 else "scum" if i < 600 else "fine"), int(i < 600)) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {"canalla", "scum"} <= set(toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).words)


def test_families_are_learned_from_two_texts(spark):
    rng = random.Random(13)
    plain = lambda n: [f"{rng.choice(['lom', 'tes', 'rik', 'wod'])}{rng.randrange(300)}" for _ in range(n)]
    rows = [(i, " ".join([*plain(30), *(["grumel" + x for x in rng.sample("abcdefgh", 4)] if i < 2 else ["idiot"] if i < 40 else ["grumelz"] if i % 40 == 0 else [])]), int(i < 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = df.select("doc_id", "text").union(spark.createDataFrame([(1000, " ".join([*plain(25), "grumelx", "grumely", "grumelq"])), (1001, "one grumelx " + " ".join(plain(30)))], "doc_id long, text string"))
    models = [toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic")) for d in (df, df.orderBy(F.desc("doc_id")).union(df.limit(5)))]
    assert models[0].families and all("grumela".startswith(x) for x in models[0].families)
    assert models[0].families == models[1].families and models[0].words == models[1].words and np.allclose(models[0].weights, models[1].weights)
    out = {r.doc_id: r.score for r in toxicity.score(asked.select("doc_id", F.lit(True).alias("held_out"), "text"), models[0]).collect()}
    assert out[1000] >= 0.3 and out[1001] < 0.3 and all((out[i] >= 0.3) == bool(y) for i, _, y in rows)


def test_quoted_terms_are_no_abuse(spark):
    rng = random.Random(14)
    plain = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    rows = [(i, f"{plain(10)} you {rng.choice(['idiot', 'moron'])} {plain(10)}" if i < 60 else plain(21), int(i < 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    said = ["she wrote {}you idiot{} and left " + plain(12), "the word {}moron{} is old " + plain(12), "{}idiot{} and {}moron{} were cut from the film " + plain(9)]
    marks = [('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")]
    quoted = [x.format(*(m * 2)) for x in said for m in marks]
    bare = [x.replace("{}", "") for x in said] + ["you idi0t " + plain(12), "such a morron you are " + plain(12)]
    asked = spark.createDataFrame(list(enumerate([*quoted, *bare, bare[0]])), "doc_id long, text string").select("doc_id", F.lit(False).alias("held_out"), "text")
    out = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert all((out[i] < 0.3) == (i < len(quoted)) for i in out) and out[len(quoted)] == out[len(out) - 1]


def test_marks_are_paired_and_words_around_tell_attacks():
    plain, quoted, attacked = 1, toxicity.QUOTED, toxicity.ATTACKED
    texts = {
        "you idiot": plain,
        '"hello" you idiot "bye"': plain,
        '"you idiot" and "bye': quoted,
        'a " b idiot c': plain,
        'a "\nidiot " c': plain,
        "‘you idiot’": quoted,
        "'you idiot'": quoted,
        "don't be an idiot, it isn't nice": plain,
        "the dogs' idiot 'tis": plain,
        "‘he isn’t an idiot’ she says": quoted,
        "é'idiot' and ”’idiot": plain,
        "»idiot« „ab“ ‚c‘": quoted,
        "„ab“ idiot „cd“": plain,
        'he shouted "you idiot" at her': attacked,
        'er schrie „du idiot“ und ging': attacked,
        '"he shouted idiot" is a line of the play': quoted,
        'idiot, noun: from "idiot" of old': plain,
        'entry "idiot" in the dictionary': quoted,
        'he shouted once and ' + "a " * toxicity.WINDOW + '"idiot"': quoted,
        '"' + "a " * toxicity.QUOTE_BYTES + 'idiot"': plain,
    }
    raw, at = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    x = toxicity.Model(words=["idiot"]).judge().features(raw, at)
    assert dict(zip(texts, np.expm1(x[:, 2]).round(6).tolist(), strict=True)) == texts


def test_typographic_punctuation_parts_words():
    texts = ["so “idiot” there", "go—idiot…", "«idiot»", "ümläut’idiot", "a ª\xadb"]
    raw, at = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    x = toxicity.Model(words=["idiot"]).judge().features(raw, at)
    # quoted once, plain, quoted, plain, none
    assert np.expm1(x[:, 0]).round(6).tolist() == [toxicity.QUOTED, 1, toxicity.QUOTED, 1, 0]
    assert toxicity.split_words(raw, at).counts.tolist() == [3, 2, 1, 2, 2]
