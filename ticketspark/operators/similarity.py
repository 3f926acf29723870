"""Similar and duplicate tickets: cosine pairs, judgements, request groups, sparse vectors and density groups."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import CJK, filled, let, normalize_request
from ..sources.written import spread, written
from .vector_join import alike_pairs, close_pairs, dense_components, nearest


#: Rows with equal vectors that are one side of a tile of pairs.
COPIES = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The array at length 1, as doubles; an array of zeros stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm))


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of vectors that have a direction, at length 1.

    None that is null, empty, all zeros or holds a null or non-finite component; rows
    without a key are left out, and a key that occurs more than once has its least vector.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = df.where(F.col(key).isNotNull() & (F.size(x) > 0)).where(~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda e: e != 0))
    return rows.groupBy(F.col(key).alias("id")).agg(F.min(x).alias("v")).select("id", unit(F.col("v")).alias("v"))


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, id) of all rows by their class of equal vectors."""
    return rows.join(classes.select(F.col("id").alias("rep"), "v"), "v").select("rep", "id")


def _of_copies(near: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, similarity) of all rows by pairs of classes (a, b, similarity), and those inside each class.

    Only classes of several rows (n) are taken apart, in pieces of about COPIES rows that meet two by two, so
    that the pairs of a frequent vector are not made in one task.
    """
    several = classes.where("n > 1").select(F.col("id").alias("rep"), "v", F.ceil(F.col("n") / COPIES).cast("int").alias("pieces"))
    if several.isEmpty():
        return near
    members = written(rows.join(several, "v").select("rep", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id"))
    pairs = near.unionByName(several.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")))
    for x in ("a", "b"):
        pairs = pairs.join(several.select(F.col("rep").alias(x), F.col("pieces").alias(f"{x}_pieces")), x, "left")
    for x in ("a", "b"):
        pairs = pairs.withColumn(f"{x}_piece", F.explode(F.sequence(F.lit(0), F.coalesce(f"{x}_pieces", F.lit(1)) - 1)))
    pairs = pairs.withColumn("inside", F.col("a") == F.col("b"))
    for x in ("a", "b"):
        side = members.select(F.col("rep").alias(x), F.col("piece").alias(f"{x}_piece"), F.col("id").alias(f"{x}_id"))
        # a piece may have got no row
        pairs = pairs.join(side, [x, f"{x}_piece"], "left").withColumn(f"{x}_id", F.when(F.col(f"{x}_pieces").isNull(), F.col(x)).otherwise(F.col(f"{x}_id"))).where(f"{x}_id is not null")
    return pairs.where("not inside or a_id < b_id").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")


def _first_members(rows: DataFrame, classes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rep, id) of all rows by their class of equal vectors, and the first n of each class."""
    members = _members(rows, classes)
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    return members, members.withColumn("place", place).where(F.col("place") <= n).drop("place")


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float = 0.85, top_k: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """All pairs (a, b, similarity), a < b, with cosine of at least threshold (over 0); exact.

    Equal vectors are one class that is joined once (vector_join.close_pairs), then
    taken apart to all pairs of their rows. Callers that want only the best ask for them: top_k
    for each row, where of copies each is paired with the first top_k + 1 ids alone, as no other
    can be among its best; max_pairs of all, best first. Rows as unit_vectors takes them.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less asks for pairs without any likeness")
    rows = written(unit_vectors(df, key, vector))
    classes = written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    near = close_pairs(classes, threshold, top_k)
    if top_k is None:
        best = _of_copies(near, rows, classes)
        return best if max_pairs is None else best.orderBy(F.desc("similarity"), "a", "b").limit(max_pairs)
    near = near.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity")
    near = near.union(near.select("rb", "ra", "similarity")).union(classes.select("id", "id", F.lit(1.0)))
    members, first = _first_members(rows, classes, top_k + 1)
    both = near.join(members.select(F.col("rep").alias("ra"), F.col("id").alias("x")), "ra").join(first.select(F.col("rep").alias("rb"), F.col("id").alias("y")), "rb").where("x <> y")
    both = both.select("x", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "a", "b"))).where(F.col("r") <= top_k)
    best = both.select("a", "b", "similarity").distinct()
    return best if max_pairs is None else best.orderBy(F.desc("similarity"), "a", "b").limit(max_pairs)


def nearest_rows(df: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """The k rows of largest cosine for each row, without itself: id, rank, other, similarity; ties to the smaller id; exact.

    Equal vectors are one class that is searched once. Rows as unit_vectors takes them; with fewer than k others all are given.
    """
    rows = written(unit_vectors(df, key, vector))
    classes = written(rows.groupBy("v").agg(F.min("id").alias("id")))
    near = nearest(classes, k).select(F.col("id").alias("ra"), F.col("other").alias("rb"), "similarity").union(classes.select("id", "id", F.lit(1.0)))
    members, first = _first_members(rows, classes, k + 1)
    both = near.join(members.select(F.col("rep").alias("ra"), "id"), "ra").join(first.select(F.col("rep").alias("rb"), F.col("id").alias("other")), "rb").where("id <> other")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return both.withColumn("rank", nth).where(F.col("rank") <= k).select("id", "rank", "other", "similarity")


FEATURES = [("organization", 3, "主体相同"), ("address", 3, "地点相同"), ("event_type", 2, "事件相同"), ("request", 1, "诉求相同"), ("time_start", 1, "时间相同")]


NAMES = [n for n, _, _ in FEATURES]


def _judged(pairs: DataFrame, threshold: float, close: float) -> DataFrame:
    """Verdicts on pairs (a, b, similarity, <feature>_same...)."""
    same = {n: F.col(f"{n}_same") for n in NAMES}
    tenths = sum((F.when(same[n], w).otherwise(0) for n, w, _ in FEATURES), F.when(F.col("similarity") >= close, 1).otherwise(0))
    near = F.when(F.col("similarity") >= close, F.format_string("语义高度相似(%.2f)", "similarity"))
    reasons = F.concat_ws("+", *[F.when(same[n], text) for n, _, text in FEATURES], near)
    details = F.struct(*[same[n].alias(f"{n}_same") for n in NAMES[:4]])
    return pairs.select("a", "b", "similarity", (tenths / 10).alias("score"), (tenths >= round(10 * threshold)).alias("duplicate"), reasons.alias("reason"), details.alias("details"))


def judge_duplicates(pairs: DataFrame, rows: DataFrame, key: str, threshold: float = 0.7, close: float = 0.9) -> DataFrame:
    """Score, verdict, reasons and details of pairs (a, b, similarity): whole tenths for equal fields that aren't blank, one for a cosine of close.

    Pairs of duplicate_candidates say themselves which fields are equal; others are joined with the rows.
    """
    if all(f"{n}_same" in pairs.columns for n in NAMES):
        return _judged(pairs, threshold, close)
    side = lambda x: rows.select(F.col(key).alias(x), *[F.col(n).alias(f"{n}_{x}") for n in NAMES])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    same = {f"{n}_same": F.coalesce(filled(F.col(f"{n}_a").cast("string")) == filled(F.col(f"{n}_b").cast("string")), F.lit(False)) for n in NAMES}
    return _judged(j.withColumns(same), threshold, close)


def _alike(rows: DataFrame, key: str, vector: str, threshold: float, fields: list[str], sets: list[list[str]]) -> DataFrame:
    """Pairs (a, b, similarity, <field>_same...) of close vectors that are equal in all fields of one of the sets.

    Fields go with the vectors to where they meet, so that no other pair is ever a row and no pair is joined.
    Rows as unit_vectors takes them; of a key that occurs more than once the least vector and fields.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less asks for pairs without any likeness")
    about = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.min(filled(F.col(f).cast("string"))).alias(f) for f in fields])
    return alike_pairs(unit_vectors(rows, key, vector).join(about, "id"), threshold, fields, sets)


def duplicate_candidates(rows: DataFrame, key: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b, similarity, and whether each of FEATURES is equal) that can be duplicates: close vectors with an equal organisation or address.

    Without either the other fields reach five tenths at most, so no duplicate is missed.
    """
    return _alike(rows, key, vector, threshold, NAMES, [["organization"], ["address"]])


def likely_duplicates(rows: DataFrame, key: str, vector: str, threshold: float = 0.85, score: float = 0.7) -> DataFrame:
    """Pairs (a, b, similarity) that judge_duplicates can give the score: the candidates with no more pairs than needed.

    Of the fields, one of the smallest sets whose weights reach the score with a
    close cosine is equal. However few values a field has, no pair is made but of close vectors.
    """
    weights = {n: w for n, w, _ in FEATURES}
    reach = [set(c) for n in range(1, len(weights) + 1) for c in combinations(weights, n) if sum(weights[f] for f in c) + 1 >= round(10 * score)]
    least = [sorted(c) for c in reach if not any(other < c for other in reach)]
    return _alike(rows, key, vector, threshold, sorted(set().union(*least)), least).select("a", "b", "similarity")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching signs of two texts (Ratcliff and Obershelp); Spark has no built-in function for it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def request_similarity(a: Column, b: Column, cosine_ab: Column | None = None, weight: float = 0.6) -> Column:
    """0 for blank, 1 for equal, 0.9 for one in the other, else the ratio, mixed with the cosine if there is one."""
    x, y = normalize_request(F.coalesce(a, F.lit(""))), normalize_request(F.coalesce(b, F.lit("")))
    ratio = sequence_ratio(x, y)
    mixed = ratio if cosine_ab is None else F.when(cosine_ab.isNull(), ratio).otherwise((1 - weight) * ratio + weight * cosine_ab)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(mixed)


def _request_links(values: DataFrame, threshold: float) -> DataFrame:
    """(head, value) of different requests (block, value, _seq) of a block that are similar enough, the earlier one first.

    A request that another holds has its rarest pair of signs there. Two whose
    ratio reaches the threshold leave so few pairs of either unmatched that their
    rarest common pair is among the rarest of both. So requests meet at rare pairs alone.
    """
    pairs = lambda v: F.when(F.length(v) < 2, F.array(v)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.substr(v, i, F.lit(2)))))
    each = written(values.withColumn("gram", F.explode(pairs(F.col("value")))))
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("block", "value").orderBy("often", "gram"))
    each = written(each.join(often, "gram").withColumn("rank", rank).select("block", "value", "_seq", "gram", "rank"))
    # of n signs, so many pairs at most stay unmatched at the threshold
    missing = F.length("value") * min(1.0, 1 - max(0.0, 1.5 * threshold - 1) * 2 / (2 - threshold))
    some = each.where(F.col("rank") <= F.floor(missing) + 1)
    side = lambda df, x: df.select("block", "gram", F.col("value").alias(f"{x}_value"), F.col("_seq").alias(f"{x}_seq"))
    met = side(some, "a").join(side(some, "b"), ["block", "gram"]).where("a_seq < b_seq")
    single = each.withColumn("gram", F.explode(F.when(F.length("value") < 2, F.array("gram")).otherwise(F.array("gram", F.substring("gram", 1, 1), F.substring("gram", 2, 1)))))
    rarest = side(each.where("rank = 1"), "a").join(side(single, "b"), ["block", "gram"]).where("a_value <> b_value and contains(b_value, a_value)")
    order = lambda x: F.when(F.col("a_seq") < F.col("b_seq"), F.col(f"{x[0]}_value")).otherwise(F.col(f"{x[1]}_value"))
    both = met.unionByName(rarest).select(order("ab").alias("head"), order("ba").alias("value")).distinct()
    held = F.contains("head", "value") | F.contains("value", "head")
    return both.withColumn("held", held).where(F.when(F.col("held"), F.lit(threshold <= 0.9)).otherwise(sequence_ratio(F.col("head"), F.col("value")) >= threshold)).select("head", "value")


def _led(values: DataFrame, threshold: float) -> DataFrame:
    """(value, leader): in order of _seq, each request joins the first leader it is similar to, or leads.

    In each round those are decided whose earlier similar ones all are.
    """
    links = written(_request_links(values, threshold))
    seq = values.select(F.col("value").alias("head"), F.col("_seq").alias("head_seq"))
    links = written(links.join(seq, "head"))
    # those that nothing is similar to before them lead at once
    open_ = written(links.select("value").distinct())
    leads = values.join(open_, "value", "left_anti").select("value", F.col("value").alias("leader"))
    while True:
        leads = written(leads)
        if not open_.limit(1).count():
            return leads
        waiting = links.join(open_.select(F.col("value").alias("head")), "head", "left_semi").select("value").distinct()
        ready = written(open_.join(waiting, "value", "left_anti"))
        first = links.join(leads.where("leader = value").select(F.col("value").alias("head")), "head", "left_semi").groupBy("value").agg(F.min_by("head", "head_seq").alias("leader"))
        leads = leads.union(ready.join(first, "value", "left").select("value", F.coalesce("leader", "value").alias("leader")))
        open_ = written(open_.join(ready, "value", "left_anti"))


def dedup_requests(df: DataFrame, key: str, request: str, threshold: float = 0.85, block: Column | None = None) -> DataFrame:
    """Groups of similar requests in order of _seq: leader, n, member ids and the longest request.

    A request joins the first leader that is similar enough; a blank one stands
    alone. Only different normalised requests are compared, those of one value of
    block (an expression over the column value) if it is given.
    """
    value = normalize_request(F.coalesce(F.col(request), F.lit("")))
    named = df.withColumn("value", value)
    values = named.where("value <> ''").groupBy("value").agg(F.min("_seq").alias("_seq"))
    values = written(values.withColumn("block", F.lit(0) if block is None else block))
    out = named.join(_led(values, threshold), "value", "left").withColumn("leader", F.coalesce("leader", F.concat(F.lit("#"), F.col(key).cast("string"))))
    return _merged(out, "leader", key, request)


def _merged(df: DataFrame, group: str, key: str, request: str) -> DataFrame:
    longest = F.max_by(request, F.struct(F.length(request), -F.col("_seq")))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("ids"), longest.alias("request"))


def group_person_request(df: DataFrame, person: str, request: str) -> DataFrame:
    """Add person_request, the key of person and normalised request; rows without either are left out."""
    full = df.where(filled(F.col(person)).isNotNull()).withColumn("__r", normalize_request(F.coalesce(F.col(request), F.lit("")))).where("__r <> ''")
    return full.withColumn("person_request", F.concat_ws("|", F.trim(person), "__r")).drop("__r")


def merge_same_person_request(df: DataFrame, key: str, person: str, request: str) -> DataFrame:
    """Requests of one person merged if equal after normalising; others stay as groups of one."""
    groups = _merged(group_person_request(df, person, request), "person_request", key, request)
    done = groups.select(F.explode("ids").alias(key))
    rest = df.join(done, key, "left_anti").dropDuplicates([key])
    return groups.drop("person_request").unionByName(rest.select(F.lit(1).cast("long").alias("n"), F.array(key).alias("ids"), F.col(request).alias("request")))


def exact_duplicates(df: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """Fingerprints that several rows have: number and smallest ids; all rows follow by joining on it."""
    return df.groupBy(fingerprint.alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("n > 1")


def tfidf(df: DataFrame, key: str, tokens: Column, max_df: float = 0.95, sublinear: bool = True) -> DataFrame:
    """Sparse vectors as rows (id, term, w) of length 1: smoothed idf, terms in more than max_df of the rows left out."""
    counts = df.select(F.col(key).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("n"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).where(F.col("df") <= max_df * F.col("n"))
    idf = idf.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    weighted = counts.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


#: So many different terms are known to all tasks at once (16 bytes each); more are joined.
VOCABULARY = 1 << 20


def _lists(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple[int, ...]]:
    """Row number and the lists of the columns, as arrays without copies, of rows with lists of equal lengths."""
    lists = [batch.column(i) for i in columns]
    starts = [x.offsets.to_numpy() for x in lists]
    values = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    for i in range(batch.num_rows):
        yield i, *[v[at[i] : at[i + 1]] for v, at in zip(values, starts, strict=True)]


def _term_lists(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, columns and weights of rows (id, cols, ws)."""
    return _lists(batch, 1, 2)


def _list_column(lists: list[np.ndarray], kind: pa.DataType, dtype: type) -> pa.Array:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype), *lists]).astype(dtype), kind))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, terms) as (id, terms, tfs): a row's different terms and how often each is there."""
    for batch in batches:
        counted = [np.unique(terms, return_counts=True) for _, terms in _lists(batch, 1)]
        columns = [_list_column([c[i] for c in counted], pa.int64(), np.int64) for i in (0, 1)]
        yield pa.record_batch([batch.column(0), *columns], ["id", "terms", "tfs"])


def _weigh(shared: Broadcast, width: int):
    """Rows (id, terms, tfs) as (id, cols, ws), by the terms and idfs that are shared, terms in order."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        for batch in batches:
            cols, ws = [], []
            for _, terms, tfs in _lists(batch, 1, 2):
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                kept = known[at] == terms
                w = (1 + np.log(tfs[kept])) * idf[at[kept]]
                col, place = np.unique(terms[kept] % width, return_inverse=True)
                cols.append(col)
                ws.append(np.bincount(place, w / (np.sqrt(w @ w) or 1.0), len(col)))
            yield pa.record_batch([batch.column(0), _list_column(cols, pa.int64(), np.int64), _list_column(ws, pa.float64(), np.float64)], ["id", "cols", "ws"])

    return weigh


def _hashed_terms(df: DataFrame, key: str, tokens: Column, width: int, max_df: float = 0.95) -> DataFrame:
    """Written rows (id, cols, ws): tfidf of each row with its terms hashed to width columns.

    A row's terms are counted where it is read, so no term is a row of a shuffle
    but once for each task that has it, for the count of its rows. Terms are known by their hashes of 64 bits.
    """
    spark = df.sparkSession
    terms = F.transform(F.array_compact(F.coalesce(tokens, F.array().cast("array<string>"))), lambda t: F.xxhash64(t))
    rows = spread(df).select(F.col(key).alias("id"), terms.alias("terms"))
    kind = dict(rows.dtypes)["id"]
    counted = written(rows.mapInArrow(_count_terms, f"id {kind}, terms array<long>, tfs array<long>"))
    n = counted.count()
    idf = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df * n)
    idf = written(idf.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    known = idf.count()
    if not 0 < known <= VOCABULARY:
        hashed = tfidf(df, key, tokens, max_df).groupBy("id", F.pmod(F.xxhash64("term"), F.lit(width)).alias("col")).agg(F.sum("w").alias("w"))
        lists = hashed.groupBy("id").agg(F.collect_list(F.struct("col", "w")).alias("x")).select("id", F.col("x.col").alias("cols"), F.col("x.w").alias("ws"))
        none = lambda t: F.array().cast(f"array<{t}>")
        lists = df.select(F.col(key).alias("id")).join(lists, "id", "left").select("id", F.coalesce("cols", none("long")).alias("cols"), F.coalesce("ws", none("double")).alias("ws"))
        return written(lists)
    table = idf.toPandas().sort_values("term")
    shared = spark.sparkContext.broadcast((table["term"].to_numpy(), table["idf"].to_numpy()))
    lists = written(counted.mapInArrow(_weigh(shared, width), f"id {kind}, cols array<long>, ws array<double>"))
    shared.destroy()
    return lists


def _times_gram(shared: Broadcast, width: int):
    """The task's part of A'A V, for the rows A it sees, as rows (col, part)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros((width, v.shape[1]))
        for batch in batches:
            for _, c, w in _term_lists(batch):
                total[c] += np.outer(w, w @ v[c])  # a row's columns are distinct
        used = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array(used), pa.array([x.tobytes() for x in total[used]], pa.binary())], ["col", "part"])

    return multiply


def _sum_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"col": pdf["col"].iloc[:1], "part": [np.sum([np.frombuffer(x) for x in pdf["part"]], axis=0).tobytes()]})


def svd_embed(df: DataFrame, key: str, tokens: Column, dim: int = 256, width: int = 4096, rounds: int = 6) -> DataFrame:
    """(id, vector): TF-IDF reduced by a truncated SVD to length-1 arrays; rows without terms get zeros.

    Terms are hashed to width columns, so the driver holds width * (dim + 8)
    numbers however many terms there are; up to some hundred terms seldom share one.
    Each row's terms are counted where it is read (_hashed_terms), and each row has its own vector.
    The largest directions come from a subspace iteration, each round of which is
    one pass over the rows.
    """
    spark = df.sparkSession
    lists = _hashed_terms(df, key, tokens, width)
    columns, n = lists.select(F.explode("cols")).distinct().count(), lists.count()
    k = max(1, min(dim, columns - 1, n - 1))
    v = np.linalg.qr(np.random.default_rng(42).normal(size=(width, min(width, k + 8))))[0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(v)
        parts = lists.mapInArrow(_times_gram(shared, width), "col long, part binary").groupBy("col").applyInPandas(_sum_parts, "col long, part binary").collect()
        product = np.zeros_like(v)
        for row in parts:
            product[row["col"]] = np.frombuffer(row["part"])
        shared.destroy()
        size, turn = np.linalg.eigh(v.T @ product)
        best = v @ turn[:, ::-1][:, :k]
        v = np.linalg.qr(product)[0]
    # each direction's sign is that of its largest part, so that runs agree
    best = best * np.sign(best[np.abs(best).argmax(0), np.arange(best.shape[1])])
    shared = spark.sparkContext.broadcast(best)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.stack([w @ shared.value[c] for _, c, w in _term_lists(batch)]) if batch.num_rows else np.zeros((0, k))
            yield pa.record_batch([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["id", "vector"])

    reduced = lists.mapInArrow(reduce_rows, f"id {dict(lists.dtypes)['id']}, vector array<double>")
    return reduced.select("id", unit(F.col("vector")).alias("vector"))


def sparse_pairs(vectors: DataFrame, min_cosine: float) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of rows (id, term, w) of length-1 vectors with at least min_cosine, exact.

    A vector's most frequent terms whose part of it is shorter than min_cosine are
    left out of the search: rows that share no other term can't be that close. So
    frequent terms seldom make candidates; their full products are worked out after.
    """
    vectors = written(vectors)
    frequency = vectors.groupBy("term").agg(F.count("*").alias("df"))
    upto = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id").orderBy(F.desc("df"), "term"))
    rare = written(vectors.join(frequency, "term").withColumn("upto", upto).where(F.col("upto") >= min_cosine**2 * (1 - 1e-9)).select("id", "term"))
    x, y = rare.alias("x"), rare.alias("y")
    pairs = x.join(y, (F.col("x.term") == F.col("y.term")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda k: vectors.select(F.col("id").alias(k), "term", F.col("w").alias(f"w{k}"))
    dots = pairs.join(side("a"), "a").join(side("b"), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return dots.where(F.col("similarity") >= min_cosine)


def connected(pairs: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the least label of neighbours, and its label, until none changes."""
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = written(lower.join(jump, "component").select("node", F.col("further").alias("component"), "was"))
        if not after.where("component <> was").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")


def density_cluster(ids: DataFrame, key: str, pairs: DataFrame, min_samples: int = 2) -> DataFrame:
    """DBSCAN over close pairs (a, b): (key, cluster_id), the least id of the group's core points, null for noise.

    A point with min_samples close points, itself included, is core; cores in
    reach of each other form a group, and others join the least group in reach.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    core = both.groupBy(F.col("a").alias("node")).agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select("node")
    inner = both.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    alone = core.join(inner.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    grouped = connected(inner).unionByName(alone)
    border = both.join(grouped.select(F.col("node").alias("b"), "component"), "b").join(core.withColumnRenamed("node", "a"), "a", "left_anti").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"))
    return ids.select(key).join(grouped.unionByName(border).withColumnsRenamed({"node": key, "component": "cluster_id"}), key, "left")


def dense_groups(df: DataFrame, key: str, vector: str, min_cosine: float, min_samples: int = 2) -> DataFrame:
    """DBSCAN over vectors, as density_cluster on all pairs of at least min_cosine, without the pairs; rows that have no direction are noise.

    Copies of a vector count as points of their own: a class of min_samples copies is core by itself.
    """
    rows = written(unit_vectors(df, key, vector))
    classes = written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    parts = dense_components(classes, min_cosine, min_samples, connected)
    found = _members(rows, classes).join(parts.select(F.col("id").alias("rep"), F.col("component").alias("cluster_id")), "rep").select(F.col("id").alias(key), "cluster_id")
    return df.select(key).join(found, key, "left")


def text_tokens(c: Column) -> Column:
    """The terms of char_ngrams, in another order: two searches of the text are faster than its runs one by one."""
    sign = f"[{CJK}a-z0-9]"
    found = lambda x: F.concat(F.regexp_extract_all(x, F.lit(sign), F.lit(0)), F.regexp_extract_all(x, F.lit(f"(?=({sign}{{2}}))"), F.lit(1)))
    return let(F.lower(F.coalesce(c, F.lit(""))), found)
