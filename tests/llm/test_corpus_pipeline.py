import itertools
import random
import re

import corpus_pipeline as pipeline
from compare import SF
from pyspark.sql import functions as F

from ticketspark.llm.near_duplicates import Plan, near_duplicates
from ticketspark.llm.packing import count_words
from ticketspark.llm.scratch import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_up(i, n=30):
    """A text of its own for each i."""
    rng = random.Random(i)
    return " ".join(rng.choice(["ba", "ko", "mi", "nu", "re"]) + rng.choice(["la", "po", "ti", "ve", "zu"]) + rng.choice("abcdefghij") for _ in range(n))


def tables(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_keep_clean_documents(spark, tmp_path):
    rows = [(i, made_up(i), "xx", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[3][1], "xx", "s", 0), (101, "!!! 123", "xx", "s", 0), (102, None, "xx", "s", 0), (103, made_up(71) + " call 523-555-1055", "xx", "s", 0), (104, "leaked " + made_up(90), "xx", "s", 0), rows[5]]
    rows += [(105, "tail " + rows[7][1], "xx", "s", 0), (106, made_up(107, 20_000), "xx", "s", 0)]
    docs = tables(spark, tmp_path, rows, [(1, made_up(90))])
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    plain = list(range(60))
    assert kept["language_id"] == sorted([*plain, 5, 100, 103, 104, 105, 106])
    assert kept["near_dedup"] == [*plain, 103, 104, 106] and kept["decontaminate"] == kept["replace_pii"] == [*plain, 103, 106]
    done = {r.doc_id: r for r in docs.collect()}
    assert "523-555-1055" not in done[103].text and done[0].text == rows[0][1] and done[0].n_chars == len(rows[0][1]) and done[106].text == rows[-1][1]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [*plain, 103, 106]
    words = {r.doc_id: r.n for r in docs.select("doc_id", count_words(F.col("text")).alias("n")).collect()}
    assert all(r.n_words == words[r.doc_id] <= r.bucket_len for r in out) and {r.doc_id for r in out if r.bucket_len > pipeline.BATCH_WORDS} == {106}
    assert near_duplicates(docs, Plan(shingle=5)).where("not kept").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and languages, clashing extra columns and an empty table go through all stages."""
    rows = [(i, made_up(i), None if i % 2 else "xx", None, None) for i in range(20)] + [(None, made_up(50), None, None, None), (None, made_up(50), "xx", None, None), (60, "", "xx", None, None)]
    tables(spark, tmp_path, rows, [(None, "x"), (1, None)])
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"component_id": F.lit(1), "kept": F.lit(False), "score": F.lit("s"), "n_pii": F.lit(None).cast("string"), "__text": F.lit("t"), "batch": F.lit(9)})
    for docs in (extra, extra.limit(0)):
        n = docs.count()
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == extra.columns, name
        # both rows without an id stay, the text without letters goes
        assert docs.count() == max(0, n - 1)
        assert pipeline.packing(spark, docs, str(tmp_path)).count() == max(0, n - 1)


def test_pipeline_against_brute_force(spark):
    """The documents of sf0.001 that all stages keep, and their numbers of words, by plain loops over whole texts."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in rows.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    head = {i: i for i in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in itertools.combinations(sorted(rows), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            head[y] = x
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))
    want = {i: len(words[i]) for i in rows if find(i) == i and not hit(word.findall(lower(rows[i])))}
    assert 0 < len(want) < len(rows)
    before = len(written())
    assert {r.doc_id: r.n_words for r in pipeline.run(spark, str(SF)).collect()} == want
    assert len(written()) - before <= 3  # the documents before the last stage, and what that writes


def test_language_id_drops_only_documents_without_letters(spark):
    schema = SCHEMA
    rows = [(i, "some words of a long enough text", "en", "s", 0) for i in range(30)]
    rows += [(100, "A.", "en", "s", 0), (101, "De.", None, "s", 0), (102, "слово", "ru", "s", 0), (103, "12 !", "en", "s", 0), (104, None, "en", "s", 0), (105, "long enough text", None, "s", 0)]
    out = {r.doc_id: r.lang for r in pipeline.language_id(spark, spark.createDataFrame(rows, schema), "").collect()}
    assert sorted(out) == [*range(30), 100, 101, 102, 105] and out[100] == "en" and out[101] is None and out[102] == "ru" and out[105] == "en"
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in rows]
    assert sorted(r.doc_id for r in pipeline.language_id(spark, spark.createDataFrame(unlabelled, schema), "").collect()) == sorted(r[0] for r in rows)
