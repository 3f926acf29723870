import pytest
from compare import SF, connect, same_rows

from ticketspark.plans import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    if name in ORACLE_SQL:
        assert same_rows(df, con, ORACLE_SQL[name])
    else:
        assert df.columns and df.count() > 0


def test_request_similarity_of_parts(spark):
    from difflib import SequenceMatcher

    rows = QUERIES["g12_request_similarity"](spark, str(SF)).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count() - 1
    for r in rows:
        a, b = r.p_name.strip().lower(), r.other.strip().lower()
        assert abs(r.s - (1.0 if a == b else 0.9 if a in b or b in a else SequenceMatcher(None, a, b).ratio())) < 1e-9


CJK = "\u4e00-\u9fff"


def _normalized(text):
    import re
    import unicodedata

    from ticketspark.plans.q_text import PAIRS

    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"https?://\S+|www\.\S+", " ", text, flags=re.ASCII)
    text = re.sub(rf"[^{CJK}A-Za-z0-9\s]", " ", text, flags=re.ASCII)
    text = re.sub(r"\s+", " ", text, flags=re.ASCII).strip(" ")
    for old, new in PAIRS:
        text = text.replace(old, new)
    return text


def test_normalized_texts_against_a_plain_loop(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.h for r in QUERIES["p7_normalize_text"](spark, str(SF)).collect()}
    assert got == {i: None if t is None else hashlib.md5(_normalized(t).encode()).hexdigest() for i, t in texts.items()}


def test_standardized_documents_against_a_plain_loop(spark):
    """Events and areas by the longest and the leftmost listed name; the texts have no Chinese signs, so no rule finds a subject in them."""
    from ticketspark.plans.q_text import NAMES

    longest = sorted(NAMES, key=len, reverse=True)
    event = lambda t: next((n for n in longest if n in t), "")
    area = lambda t: min(((t.index(n), -len(n), n) for n in NAMES if n in t), default=(0, 0, ""))[2]
    got = {r.order_id: (r.extracted_event, r.extracted_area) for r in QUERIES["x23_standardize_tickets"](spark, str(SF)).collect()}
    found = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        content, title = _normalized(r.text or ""), _normalized((r.text or "").split("\n")[0])
        expected = (event(title) or event(content), area(r.source or "") or area(content) or area(title))
        assert got[str(r.doc_id)] == expected
        found += expected != ("", "")
    assert found


def test_requests_of_odd_texts(spark, tmp_path):
    """Blank, null and mixed texts: the query's rows are those of its SQL."""
    import duckdb

    texts = [None, "", " ", "\n", "x", "the", "MIT\nLicense", "MIT License", "our token, the moron", "$$$", "请", "请 que", "cen"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = QUERIES["x15_extract_request"](spark, str(tmp_path))
    assert same_rows(df, con, ORACLE_SQL["x15_extract_request"])
    assert {r.doc_id: r.issue for r in df.collect()}[1] == "none"


def _crowded(spark, folder):
    """130 close vectors, copies among them, and some far ones; ids with gaps."""
    import numpy as np

    rng = np.random.default_rng(4)
    v = np.concatenate([np.ones((130, 8)) + 0.02 * rng.normal(size=(130, 8)), rng.normal(size=(20, 8))])
    v[3:6] = v[3]
    rows = [(int(i), [float(x) for x in row], 0) for i, row in zip(rng.permutation(1000)[:150], v, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")


def test_close_copies_of_crowded_vectors(spark, tmp_path):
    """More than 100 partners each: no pair is left out, and a copy is made of the next id, however far that is."""
    import duckdb

    _crowded(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = QUERIES["j7_close_copies"](spark, str(tmp_path))
    assert df.count() > 130 * 129 / 2
    assert same_rows(df, con, ORACLE_SQL["j7_close_copies"])


def test_similar_pairs_of_crowded_vectors(spark, tmp_path):
    """The query and the operator as it is called without limits give each of a vector's 129 partners."""
    import duckdb

    from ticketspark.operators.similarity import similar_pairs

    _crowded(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = QUERIES["j7_similar_pairs"](spark, str(tmp_path))
    assert same_rows(df, con, ORACLE_SQL["j7_similar_pairs"])
    assert similar_pairs(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding").count() >= 130 * 129 / 2
