"""Counts and roll-ups over classified tickets, cleaned tables and gold pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import event_name, filled
from .recurrence import modes

LEVELS = {"town": ["town"], "community": ["town", "community"], "address": ["address_normalized"]}


def daily_counts(df: DataFrame, *by: str) -> DataFrame:
    """Tickets of each day (and group); rows without a time are left out."""
    return df.where("submit_time is not null").groupBy(*by, F.date_format("submit_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def daily_counts_by_area(df: DataFrame, coords: DataFrame) -> DataFrame:
    """daily_counts of the areas that have coordinates."""
    return daily_counts(df.join(coords.select(F.col("area").alias("extracted_area")), "extracted_area", "left_semi"), "extracted_area")


def attach_coords(df: DataFrame, coords: DataFrame, area: str = "area", how: str = "left") -> DataFrame:
    """lat and lon of each area; inner leaves out areas without."""
    return df.join(coords.select(F.col("area").alias(area), "lat", "lon"), area, how)


def event_area_counts(df: DataFrame, coords: DataFrame) -> DataFrame:
    """Tickets of each cluster and area, with coordinates where known."""
    counts = df.groupBy("cluster_id", filled(F.col("extracted_area")).alias("area")).agg(F.count("*").alias("n")).where("area is not null")
    return attach_coords(counts, coords)


def kpis(df: DataFrame, events: DataFrame) -> DataFrame:
    """One row: tickets, recurring groups, different subjects and events, name of the largest event."""
    one = df.agg(
        F.count("*").alias("total_orders"), F.count_distinct(F.when(F.col("is_multi_freq"), F.col("cluster_id"))).alias("multi_events"),
        F.count_distinct(filled(F.col("extracted_subject"))).alias("total_subjects"), F.count_distinct(filled(F.col("extracted_event"))).alias("total_events"),
    )
    subject, kind = F.col("event_subject"), F.col("event_type")
    name = F.when((subject == "") | subject.startswith("（") | subject.startswith("多主体聚合"), kind).otherwise(subject)
    biggest = events.agg(F.min_by(name, F.struct((-F.col("frequency")).alias("f"), "cluster_id")).alias("biggest_event"))
    return one.crossJoin(F.broadcast(biggest)).withColumn("biggest_event", F.coalesce("biggest_event", F.lit("—")))


def area_overview(df: DataFrame, events: DataFrame, coords: DataFrame, k: int = 5) -> DataFrame:
    """Areas with coordinates: tickets, recurring ones, and the k events with most tickets there."""
    area = filled(F.col("extracted_area")).alias("area")
    totals = df.groupBy(area).agg(F.count("*").alias("total"), F.count_if("is_multi_freq").alias("multi")).where("area is not null")
    local = df.where("is_multi_freq").groupBy(area, "cluster_id").agg(F.count("*").alias("frequency")).where("area is not null")
    named = local.join(events.select("cluster_id", "event_id", event_name(F.col("event_subject"), F.col("event_type")).alias("name")), "cluster_id")
    rank = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("frequency"), "event_id"))
    best = named.withColumn("__r", rank).where(F.col("__r") <= k).groupBy("area").agg(F.sort_array(F.collect_list(F.struct("__r", "event_id", "name", "frequency"))).alias("top_events"))
    best = best.withColumn("top_events", F.transform("top_events", lambda x: F.struct(x["event_id"].alias("event_id"), x["name"].alias("name"), x["frequency"].alias("frequency"))))
    return attach_coords(totals, coords, how="inner").join(best, "area", "left")


def _top(df: DataFrame, field: str, name: str, n: int, where: Column | None = None) -> DataFrame:
    counts = df.groupBy(filled(F.col(field)).alias(name)).agg(F.count("*").alias("n")).where(F.col(name).isNotNull())
    return (counts if where is None else counts.where(where)).orderBy(F.desc("n"), name).limit(n)


def top_subjects(df: DataFrame, n: int = 30) -> DataFrame:
    """Commonest subjects that are no aggregate labels."""
    return _top(df, "extracted_subject", "subject", n, ~F.col("subject").startswith("多主体聚合"))


def top_categories(df: DataFrame, n: int = 30) -> DataFrame:
    return _top(df, "extracted_event", "category", n)


def overview(df: DataFrame, events: DataFrame, coords: DataFrame) -> dict[str, DataFrame]:
    """All parts of the overview, each a table of its own."""
    source = df.agg(F.count("*").alias("n_rows"), F.date_format(F.min("submit_time"), "yyyy-MM-dd").alias("time_min"), F.date_format(F.max("submit_time"), "yyyy-MM-dd").alias("time_max"), F.count_if("is_multi_freq").alias("multi_orders"))
    return {
        "source": source, "areas": area_overview(df, events, coords), "daily": daily_counts(df), "daily_by_area": daily_counts_by_area(df, coords),
        "subjects": top_subjects(df), "categories": top_categories(df),
    }


def group_by_organization(df: DataFrame, min_count: int = 1, limit: int = 200) -> DataFrame:
    """Organisations with at least min_count tickets, most first, with their ticket ids in order.

    The largest are found by counting; only their ids are gathered.
    """
    return _grouped(df, ["organization"], min_count, limit)


def group_by_address(df: DataFrame, level: str = "town", min_count: int = 1, limit: int = 200) -> DataFrame:
    """The same by town, community or whole address; an unknown level counts as town."""
    return _grouped(df, LEVELS.get(level, LEVELS["town"]), min_count, limit)


def _grouped(df: DataFrame, keys: list[str], min_count: int, limit: int) -> DataFrame:
    full = df.where(" and ".join(f"coalesce({k}, '') <> ''" for k in keys))
    best = full.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), *keys).limit(limit)
    ids = full.join(F.broadcast(best), keys).groupBy(*keys, "n").agg(F.sort_array(F.collect_list("ticket_no")).alias("ticket_nos"))
    return ids.select(*keys, F.col("n").alias("ticket_count"), "ticket_nos")


def group_members(df: DataFrame, keys: list[str], min_count: int = 1, limit: int = 200) -> DataFrame:
    """The same groups as rows (keys, ticket_count, ticket_no), so that no group becomes one value however many tickets it has."""
    full = df.where(" and ".join(f"coalesce({k}, '') <> ''" for k in keys))
    best = full.groupBy(*keys).agg(F.count("*").alias("ticket_count")).where(F.col("ticket_count") >= min_count).orderBy(F.desc("ticket_count"), *keys).limit(limit)
    return full.join(best, keys).select(*keys, "ticket_count", "ticket_no")


def town_tree(df: DataFrame, min_count: int = 1) -> DataFrame:
    """Towns with at least min_count tickets, each with its communities: array<struct<name, n>> by size, then name."""
    full = df.where("coalesce(town, '') <> ''")
    towns = full.groupBy("town").agg(F.count("*").alias("ticket_count")).where(F.col("ticket_count") >= min_count)
    inner = full.where("coalesce(community, '') <> ''").groupBy("town", "community").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    one = F.struct((-F.col("n")).alias("m"), F.col("community").alias("name"))
    children = inner.groupBy("town").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["name"].alias("name"), (-x["m"]).alias("n"))).alias("children"))
    return towns.join(children, "town", "left").withColumn("children", F.coalesce("children", F.expr("cast(array() as array<struct<name:string,n:bigint>>)")))


def list_values(df: DataFrame, field: str) -> DataFrame:
    """Different values that aren't blank, with counts: event types, towns."""
    return df.groupBy(filled(F.col(field)).alias("name")).agg(F.count("*").alias("n")).where("name is not null")


def job_stats(df: DataFrame) -> DataFrame:
    """One row: tickets, usable and failed ones, and how often organisation, address, event and request are known (4 places)."""
    rate = lambda c: F.coalesce(F.bround(F.try_divide(F.count_if(filled(F.col(c)).isNotNull()), F.count("*")), 4), F.lit(0.0)).alias(f"{c}_rate")
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("is_usable")).alias("usable"), F.count_if(F.col("parse_status") == "failed").alias("failed"),
        *[rate(c) for c in ("organization", "address_normalized", "event_type", "request")],
    )


def hit_rates(df: DataFrame) -> DataFrame:
    """Share of tickets with a subject, event and area."""
    return df.agg(*[F.coalesce(F.try_divide(F.count_if(filled(F.col(f"extracted_{x}")).isNotNull()), F.count("*")), F.lit(0.0)).alias(f"{x}_rate") for x in ("subject", "event", "area")])


def gold_clusters(gold: DataFrame, clusters: DataFrame) -> DataFrame:
    """Gold pairs (id_a, id_b, label, …) with both groups, as cluster_a and cluster_b; null where an id is unknown."""
    side = lambda x: clusters.select(F.col("order_id").alias(f"id_{x}"), F.col("cluster_id").alias(f"cluster_{x}"))
    return gold.join(side("a"), "id_a", "left").join(side("b"), "id_b", "left")


def missing_gold(gold: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ids of gold pairs that have no group."""
    ids = gold.select(F.col("id_a").alias("order_id")).union(gold.select("id_b")).distinct()
    return ids.join(clusters.select("order_id"), "order_id", "left_anti")


def pair_eval(gold: DataFrame, clusters: DataFrame, *by: str) -> DataFrame:
    """Right and wrong pairs, precision, recall and F1 (0 where undefined), overall or by category; pairs with an unknown id are left out."""
    pairs = gold_clusters(gold, clusters).where("cluster_a is not null and cluster_b is not null")
    said, true = (F.col("cluster_a") == F.col("cluster_b")) & (F.col("cluster_a") != -1), F.col("label") == 1
    counts = {"tp": said & true, "fp": said & ~true, "fn": ~said & true, "tn": ~said & ~true}
    out = pairs.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def wrong_pairs(gold: DataFrame, clusters: DataFrame) -> DataFrame:
    """Gold pairs judged wrongly: 误并 if merged, 漏并 if not."""
    pairs = gold_clusters(gold, clusters).where("cluster_a is not null and cluster_b is not null")
    said = (F.col("cluster_a") == F.col("cluster_b")) & (F.col("cluster_a") != -1)
    return pairs.where(said != (F.col("label") == 1)).withColumn("error", F.when(said, "误并").otherwise("漏并"))


def profile_input(df: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """Commonest titles and areas, and the range of valid times."""
    return {"titles": _top(df, "title", "title", n), "areas": _top(df, "area", "area", n), "times": df.agg(F.count("submit_time").alias("valid"), F.min("submit_time").alias("first"), F.max("submit_time").alias("last"))}


def top_clusters(df: DataFrame, n: int = 12) -> DataFrame:
    """Largest groups with their commonest event, subject and title.

    -1 counts as a group here, as in a plain count of values.
    """
    sizes = df.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(n)
    names = {"event": F.col("extracted_event"), "subject": F.col("extracted_subject"), "title": F.col("title")}
    inside = df.join(F.broadcast(sizes.select("cluster_id")), "cluster_id", "left_semi")  # n rows at most
    out = sizes.join(modes(inside, "cluster_id", names), "cluster_id", "left")
    return out.withColumns({x: F.coalesce(x, F.lit("")) for x in names}).orderBy(F.desc("n"), "cluster_id")
