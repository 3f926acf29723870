"""Searches, pages, exported tables and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, fmt_seen, mask_pii, truncate
from ..sources.written import written
from .pages import deep_page

MAX_PAGE = 200
#: From this row on a page is found by counts of ranges; before it, by the best rows of each task.
DEEP = 10_000


def search_orders(df: DataFrame, q: str = "", area: str = "", subject: str = "", multi: str = "", category: str = "", event: str = "", events: DataFrame | None = None) -> DataFrame:
    """Tickets that hold q (any case, as it is) in content, id or title and have the given area, subject, flag, event type and event; an unknown event has none."""
    if q:
        df = df.where(F.greatest(*[F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower())).cast("int") for c in ("content", "order_id", "title") if c in df.columns]) == 1)
    for value, column in ((area, "extracted_area"), (subject, "extracted_subject"), (category, "extracted_event")):
        if value:
            df = df.where(F.col(column) == value)
    if multi in ("0", "1"):
        df = df.where(F.col("is_multi_freq") == (multi == "1"))
    if event:
        df = df.join(events.where(F.col("event_id") == event).select("cluster_id"), "cluster_id", "left_semi")
    return df


def search_cleaned(df: DataFrame, organization: str = "", town: str = "", community: str = "", event_type: str = "", keyword: str = "", usable_only: bool = False, limit: int = 100, offset: int = 0, order: str = "_seq") -> tuple[DataFrame, DataFrame]:
    """A page of the cleaned tickets that fit, and a row with the number of all of them."""
    for value, column in ((organization, "organization"), (town, "town"), (community, "community"), (event_type, "event_type")):
        if value:
            df = df.where(F.col(column) == value)
    if keyword:
        inside = [F.contains(F.coalesce(c, F.lit("")), F.lit(keyword)).cast("int") for c in ("clean_content", "semantic_content", "raw_content") if c in df.columns]
        df = df.where(F.greatest(F.lit(0), *inside) == 1)
    if usable_only:
        df = usable(df)
    page = df.drop("embedding").orderBy(order).offset(offset).limit(limit)
    return page, df.agg(F.count("*").alias("total"))


def usable(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("is_usable", F.lit(False)))


def with_status(df: DataFrame, *statuses: str) -> DataFrame:
    return df.where(F.col("parse_status").isin(*statuses))


def status_counts(df: DataFrame) -> DataFrame:
    """One row: successful and failed rows."""
    return df.agg(F.count_if(F.col("parse_status") != "failed").alias("success"), F.count_if(F.col("parse_status") == "failed").alias("failed"))


def having_min_count(df: DataFrame, key: str, k: int) -> DataFrame:
    """Keys with at least k rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= k)


def attach_events(df: DataFrame, events: DataFrame) -> DataFrame:
    """Event id, type and frequency of each ticket's group; '' and 0 without one."""
    e = events.select("cluster_id", "event_id", "event_type", F.col("frequency").alias("event_frequency"))
    return df.join(e, "cluster_id", "left").withColumns({"event_id": F.coalesce("event_id", F.lit("")), "event_type": F.coalesce("event_type", F.lit("")), "event_frequency": F.coalesce("event_frequency", F.lit(0))})


def results_table(df: DataFrame, events: DataFrame) -> DataFrame:
    """The exported table of 12 columns, by frequency, then time text, both descending."""
    out = attach_events(df, events).select(
        F.col("order_id").alias("工单编号"), F.col("content").alias("原始诉求"), F.col("subject").alias("涉及主体"), F.col("area").alias("事发区域"),
        F.date_format("submit_time", "yyyy-MM-dd HH:mm").alias("提交时间"), F.col("normalized_content").alias("标准化内容"),
        F.col("extracted_subject").alias("核心主体"), F.col("extracted_event").alias("核心事件"), F.col("cluster_id").alias("聚类ID"),
        F.col("cluster_size").alias("聚类频次"), F.when(F.col("is_multi_freq"), "是").otherwise("否").alias("是否多频"), F.col("event_id").alias("事件编号"),
    )
    return out.orderBy(F.desc("聚类频次"), F.desc_nulls_last("提交时间"), "工单编号")


def event_summary(events: DataFrame) -> DataFrame:
    names = {"event_id": "事件编号", "event_subject": "核心主体", "event_type": "事件类型", "area": "区域", "frequency": "频次", "first_seen": "首次出现", "last_seen": "最近出现"}
    return events.select(*[F.col(c).alias(n) for c, n in names.items()])


def orders_page(df: DataFrame, events: DataFrame, page: int = 1, size: int = 50, sort: str = "default", **search) -> tuple[DataFrame, DataFrame]:
    """A page of the tickets found (search_orders), by group size or time, and a row with the number of all."""
    found = search_orders(df, events=events, **search)
    size, page = min(max(1, size), MAX_PAGE), max(1, page)
    order = [("submit_time" if sort == "time" else "cluster_size", True), ("order_id", False)]
    offset = (page - 1) * size
    if offset > DEEP:
        found = written(found)
        rows = attach_events(deep_page(found, order, offset, size), events)
    else:
        first = F.desc_nulls_last("submit_time") if sort == "time" else F.desc("cluster_size")
        rows = attach_events(found.orderBy(first, "order_id").offset(offset).limit(size), events)
    shown = rows.select(
        "order_id", F.substring(F.coalesce("title", F.lit("")), 1, 60).alias("title"), mask_pii(truncate(F.col("content"), 60)).alias("content"), F.col("extracted_area").alias("area"),
        F.col("extracted_subject").alias("subject"), F.col("event_type").alias("event"), "event_id", F.col("cluster_size").alias("size"), F.col("is_multi_freq").alias("multi"), fmt_seen(F.col("submit_time")).alias("time"),
    )
    return shown, found.agg(F.count("*").alias("total"))


def dashboard_orders(df: DataFrame, n: int = 2000) -> DataFrame:
    """The first n tickets: recurring first, then large groups; contents masked and cut to 60 signs."""
    best = df.orderBy(F.desc("is_multi_freq"), F.desc("cluster_size"), "order_id").limit(n)
    return best.select(
        "order_id", mask_pii(truncate(F.col("content"), 60)).alias("content"), F.col("extracted_subject").alias("subject"), F.col("extracted_event").alias("event"), F.col("extracted_area").alias("area"),
        fmt_seen(F.col("submit_time")).alias("time"), F.col("cluster_size").alias("size"), F.col("is_multi_freq").alias("multi"),
    )


def top_events(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(F.desc("frequency"), "event_id").limit(n)


def digest(events: DataFrame, n: int = 5) -> DataFrame:
    """A line of text for each of the n largest events."""
    ids = F.array_join(F.transform(F.slice("sample_orders", 1, 2), lambda x: x["order_id"]), "、")
    line = F.format_string("%s %s · %s（%s）：%d 件，%s 至 %s，例：%s", "event_id", "event_subject", "event_type", "area", "frequency", "first_seen", "last_seen", ids)
    return top_events(events, n).select("event_id", line.alias("line"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "order_id") -> DataFrame:
    """n rows by a hash of their id: the same rows for the same seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def full_table(df: DataFrame) -> DataFrame:
    """The table of 9 columns shown on the dashboard."""
    return df.select(
        F.col("order_id").alias("工单编号"), truncate(F.col("content"), 50).alias("原始诉求"), F.col("extracted_subject").alias("核心主体"), F.col("extracted_event").alias("核心事件"), F.col("extracted_area").alias("区域"),
        F.date_format("submit_time", "yyyy-MM-dd HH:mm").alias("提交时间"), F.col("cluster_id").alias("聚类ID"), F.col("cluster_size").alias("聚类频次"), F.when(F.col("is_multi_freq"), "是").otherwise("否").alias("是否多频"),
    )


def stratified_sample(df: DataFrame, category: str, k_titles: int = 3, rows: int = 3, k_subjects: int = 3, rows_subject: int = 2) -> DataFrame:
    """Of each category the first rows of its commonest titles, then of its commonest subjects that aren't blank; each ticket once."""

    def part(column: str, k: int, n: int, turn: int) -> DataFrame:
        full = df.where(filled(F.col(column)).isNotNull())
        counts = full.groupBy(category, column).agg(F.count("*").alias("__n"))
        best = counts.withColumn("__k", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("__n"), column))).where(F.col("__k") <= k)
        ranked = full.join(best, [category, column]).withColumn("__r", F.row_number().over(Window.partitionBy(category, column).orderBy("_seq")))
        return ranked.where(F.col("__r") <= n).select(category, "order_id", "title", "extracted_subject", F.lit(turn).alias("turn"))

    both = part("title", k_titles, rows, 1).unionByName(part("extracted_subject", k_subjects, rows_subject, 2))
    return both.groupBy(category, "order_id", "title", "extracted_subject").agg(F.min("turn").alias("turn"))
