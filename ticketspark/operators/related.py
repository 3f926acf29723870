"""Tickets and events that belong together: same place, same organisation, similar events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pack_zh import DISTRICT
from ..functions.text import addr_contains, blank, has_landmark, norm_subject
from ..sources.written import written

#: Tickets of a place that are one side of a tile of pairs.
TILE_ROWS = 4096

FIELDS = ["addr_norm", "addr_community", "addr_building", "extracted_subject", "extracted_area"]


def _places(df: DataFrame) -> DataFrame:
    """Ids with their place fields; a district alone is no address."""
    addr, comm, bld, subj, area = (blank(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS)
    addr = F.when(addr == DISTRICT, "").otherwise(addr)
    return df.select("order_id", addr.alias("addr"), comm.alias("comm"), bld.alias("bld"), norm_subject(subj).alias("subj"), area.alias("area"), *[c for c in ("cluster_id",) if c in df.columns])


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(kind), *parts)


def _exact() -> Column:
    """One key for each way in which tickets with equal fields share a place."""
    c = F.col
    keys = F.array(
        F.when(c("addr") != "", _key("a", c("addr"))),
        F.when((c("comm") != "") & (c("bld") != ""), _key("cb", c("comm"), c("bld"))),
        F.when((c("comm") == "") & (c("bld") != ""), _key("b", c("bld"))),
        F.when((c("comm") == "") & (c("subj") != ""), _key("s", c("subj"), c("area"))),
    )
    return F.array_compact(keys)


def _around() -> Column:
    """What must be equal beside addresses one of which holds the other: the community, or subject and area."""
    c = F.col
    return F.array_compact(F.array(F.when(c("comm") != "", _key("ci", c("comm"))), F.when(c("subj") != "", _key("si", c("subj"), c("area")))))


def place_members(df: DataFrame) -> DataFrame:
    """Rows (order_id, place, core): two tickets are at one place if they share a place that one of them is a core of.

    Tickets with equal fields are all cores of a place. An address that others
    hold is a place too: its tickets are the cores, those whose longer address
    holds it belong to it. Only different addresses are compared, and only those
    that share the shorter one's first five signs. So however many tickets a
    place has, each has a row for each of its few places. Places of one ticket are left out.
    """
    places = _places(df)
    exact = places.select("order_id", F.explode(_exact()).alias("place"), F.lit(True).alias("core"))

    near = places.where("addr <> ''").select("order_id", "addr", F.explode(_around()).alias("around"))
    short = F.regexp_replace("addr", "[0-9０-９]", "")
    kinds = near.select("around", "addr").distinct().withColumn("plain", short).where(F.length("plain") >= 5)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("plain") - 4), lambda i: F.substr("plain", i, F.lit(5))))
    inner = kinds.where(has_landmark(F.col("plain"))).select("around", F.substring("plain", 1, 5).alias("gram"), F.col("addr").alias("held"), F.col("plain").alias("held_plain"))
    outer = kinds.select("around", F.explode(grams).alias("gram"), "addr", "plain")
    holds = inner.join(outer, ["around", "gram"]).where((F.col("held") != F.col("addr")) & F.contains("plain", "held_plain")).select("around", "held", "addr")
    place = F.concat_ws("\x1f", "around", "held").alias("place")
    cores = near.join(holds.select("around", F.col("held").alias("addr")).distinct(), ["around", "addr"]).select("order_id", F.concat_ws("\x1f", "around", "addr").alias("place"), F.lit(True).alias("core"))
    others = near.join(holds, ["around", "addr"]).select("order_id", place, F.lit(False).alias("core"))

    members = exact.union(cores).union(others)
    return members.join(members.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place"), "place", "left_semi").select("order_id", "place", "core")


def same_place(a: str, b: str) -> Column:
    """Whether two tickets, as aliases a and b, are at one place by their fields."""
    x = {f"{t}{n}": F.col(f"{t}.{n}") for t in (a, b) for n in ("addr", "comm", "bld", "subj", "area")}
    v = lambda n: (x[a + n], x[b + n])
    equal = lambda n: (v(n)[0] != "") & (v(n)[0] == v(n)[1])
    inside = addr_contains(*v("addr"))
    no_comm = (v("comm")[0] == "") & (v("comm")[1] == "")
    return (
        equal("addr")
        | (equal("comm") & (equal("bld") | inside))
        | (no_comm & equal("bld"))
        | (equal("subj") & (v("area")[0] == v("area")[1]) & (inside | no_comm))
    )


def _pairs_once(members: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of tickets that share a place of which one is a core, each made once.

    A row says which places before its own its ticket has, so a pair is passed over at all
    but its first place. The tickets of a place are cut into pieces of about tile_rows, which meet two by two.
    """
    spark, rows = members.sparkSession, tile_rows or TILE_ROWS
    members = written(members.groupBy("order_id", "place").agg(F.max("core").alias("core")))
    sizes = members.groupBy("place").agg(F.ceil(F.count("*") / rows).cast("int").alias("pieces"))
    of = members.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("place", "core"))).alias("all"))
    at = of.select("order_id", "all", F.posexplode("all").alias("nth", "at")).withColumn("before", F.slice("all", 1, F.col("nth")))
    cores = F.transform(F.filter("before", lambda p: p["core"]), lambda p: p["place"])
    at = at.select("order_id", "at.place", "at.core", F.col("before.place").alias("before"), cores.alias("cores")).join(sizes, "place")
    at = written(at.withColumn("piece", F.pmod(F.xxhash64("order_id"), F.col("pieces")).cast("int")))
    # by number, so that few bytes that make many pairs are not put into one task
    deal = lambda d: d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place", "i", "j")
    x = deal(at.withColumn("i", F.col("piece")).withColumn("j", F.explode(F.sequence("piece", F.col("pieces") - 1)))).alias("x")
    y = deal(at.withColumn("j", F.col("piece")).withColumn("i", F.explode(F.sequence(F.lit(0), "piece")))).alias("y")
    c = F.col
    earlier = F.arrays_overlap("x.cores", "y.before") | F.arrays_overlap("x.before", "y.cores")
    pairs = x.join(y, [c(f"x.{k}") == c(f"y.{k}") for k in ("place", "i", "j")]).where((c("x.core") | c("y.core")) & ((c("x.i") < c("x.j")) | (c("x.order_id") < c("y.order_id"))) & ~earlier)
    return pairs.select(F.least("x.order_id", "y.order_id").alias("a"), F.greatest("x.order_id", "y.order_id").alias("b"))


def same_place_pairs(df: DataFrame, similar: DataFrame | None = None, min_similarity: float = 0.65) -> DataFrame:
    """Pairs (a, b), a < b, of tickets at one place.

    For tables of which all pairs are wanted; place_members says the same in as
    many rows as tickets have places. A pair is made at the first of its places
    alone, so pairs are not shuffled, and large places are dealt to tasks in
    tiles. similar (a, b, similarity) adds pairs of one
    cluster that both have no place fields at all.
    """
    out = _pairs_once(place_members(df))
    if similar is not None:
        empty = _places(df).where("addr = '' and comm = '' and bld = ''")
        side = lambda x: empty.select(F.col("order_id").alias(x), F.col("cluster_id").alias(f"c{x}"))
        near = similar.where(F.col("similarity") >= min_similarity).join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b")
        out = out.union(near).distinct()
    return out


def related_sorted(pairs: DataFrame, df: DataFrame, order_id: str) -> DataFrame:
    """Tickets paired with one, latest first."""
    mates = pairs.where((F.col("a") == order_id) | (F.col("b") == order_id)).select(F.when(F.col("a") == order_id, F.col("b")).otherwise(F.col("a")).alias("order_id"))
    return df.join(mates, "order_id", "left_semi").orderBy(F.desc_nulls_last(F.date_format("submit_time", "yyyy-MM-dd HH:mm")), "order_id")


def related_to(members: DataFrame, df: DataFrame, order_id: str) -> DataFrame:
    """The same from place_members: only the ticket's own places are looked at."""
    own = members.where(F.col("order_id") == order_id).select("place", F.col("core").alias("own_core"))
    mates = members.where(F.col("order_id") != order_id).join(own, "place").where("core or own_core").select("order_id")
    return df.join(mates, "order_id", "left_semi").orderBy(F.desc_nulls_last(F.date_format("submit_time", "yyyy-MM-dd HH:mm")), "order_id")


def related_by_organization(df: DataFrame, organization: str, exclude: str, limit: int = 50) -> DataFrame:
    return df.where((F.col("organization") == organization) & (F.col("ticket_no") != exclude)).orderBy("ticket_no").limit(limit)


def related_by_address(df: DataFrame, town: str, exclude: str, community: str = "", limit: int = 50) -> DataFrame:
    found = df.where((F.col("town") == town) & (F.col("ticket_no") != exclude))
    return (found.where(F.col("community") == community) if community else found).orderBy("ticket_no").limit(limit)


def similar_not_duplicate(events: DataFrame, k: int = 3) -> DataFrame:
    """Up to k other events of each event's type, in order of event id.

    Only the first k + 1 events of a type can be asked for, so each event is
    paired with those alone.
    """
    ranked = events.withColumn("__r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    first = ranked.where(F.col("__r") <= k + 1).select("event_type", F.col("event_id").alias("other_id"), F.col("area").alias("other_area"), F.col("frequency").alias("other_frequency"))
    pairs = events.select("event_id", "event_type").join(first, "event_type").where("event_id <> other_id")
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("other_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def match_basis(df: DataFrame, events: DataFrame) -> DataFrame:
    """For each ticket of an event, whether label, area and subject agree with the event's: 一致, 不一致 or 缺失."""
    e = events.select("cluster_id", F.col("event_type").alias("__t"), F.col("area").alias("__a"), F.col("event_subject").alias("__s"))
    j = df.join(e, "cluster_id")
    area, subject = blank(F.coalesce("extracted_area", F.lit(""))), blank(F.coalesce("extracted_subject", F.lit("")))
    agree = lambda ok: F.when(ok, "一致").otherwise("不一致")
    named = (F.col("__s") != "") & ~F.col("__s").startswith("（") & ~F.col("__s").startswith("多主体聚合")
    like = (subject != "") & (F.contains(subject, F.col("__s")) | F.contains(F.col("__s"), subject))
    return j.select(
        "order_id", "cluster_id", F.when(F.col("__t") != "", "一致").otherwise("缺失").alias("label_basis"),
        F.when((F.col("__a") != "") & (area != ""), agree(area == F.col("__a"))).otherwise("缺失").alias("area_basis"),
        F.when(named, agree(like)).otherwise("缺失").alias("subject_basis"),
    )


def ticket_detail(df: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """For every ticket: event, number of tickets at the same place, basis, and similar events."""
    mates = pairs.select(F.col("a").alias("order_id")).union(pairs.select("b")).groupBy("order_id").agg(F.count("*").alias("n_related"))
    others = similar_not_duplicate(events).groupBy("event_id").agg(F.sort_array(F.collect_list("other_id")).alias("similar_events"))
    event = events.select("cluster_id", "event_id", "frequency").join(others, "event_id", "left")
    out = df.select("order_id", "cluster_id").join(event, "cluster_id", "left").join(mates, "order_id", "left").join(match_basis(df, events).drop("cluster_id"), "order_id", "left")
    return out.withColumn("n_related", F.coalesce("n_related", F.lit(0)))
