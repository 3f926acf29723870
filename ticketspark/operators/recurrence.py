"""Recurring groups: sizes, modes, profiles and their measures. Groups are numbered in cluster_id, -1 is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, fmt_seen, truncate
from ..sources.written import written

THRESHOLD, MAX_EVENTS, SAMPLES, SAMPLE_CHARS = 3, 500, 8, 80


def cluster_size(df: DataFrame) -> DataFrame:
    """Add cluster_size to every row, by one aggregate that is joined back: a large group costs no window."""
    return df.join(df.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")), "cluster_id")


def modes(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, fields...): the commonest value of each field that isn't blank, of equals the smallest; null without one. A key has a row if any field has a value.

    Values are counted by key, field and value first, so that a large group is
    counted by many tasks, and what is left of it in one task is its best value so far.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), filled(c).alias("v")) for i, c in enumerate(fields.values())]))
    counts = df.select(key, each.alias("f")).select(key, "f.i", "f.v").where("v is not null").groupBy(key, "i", "v").agg(F.count("*").alias("n"))
    best = [F.min(F.when(F.col("i") == i, F.struct((-F.col("n")).alias("n"), "v")))["v"].alias(name) for i, name in enumerate(fields)]
    return counts.groupBy(key).agg(*best)


def group_mode(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, mode) for each key; '' if all values are blank."""
    return df.select(key).distinct().join(modes(df, key, {"mode": F.col(field)}), key, "left").withColumn("mode", F.coalesce("mode", F.lit("")))


def classify_recurring(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Add cluster_size, is_multi_freq and the modes cluster_subject, cluster_event, cluster_area ('' for no group)."""
    names = {f"cluster_{x}": F.col(f"extracted_{x}") for x in ("subject", "event", "area")}
    groups = df.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).join(modes(df.where("cluster_id <> -1"), "cluster_id", names), "cluster_id", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit("")) for c in names})
    groups = groups.withColumn("is_multi_freq", (F.col("cluster_id") != -1) & (F.col("cluster_size") >= threshold))
    return df.join(groups, "cluster_id")


def recurrence_metrics(df: DataFrame) -> DataFrame:
    """One row for each cluster_id with its measures; submitter may be absent, then its measures are null."""
    subject, area = filled(F.col("extracted_subject")), filled(F.col("extracted_area"))

    def top(name: str, c: Column) -> DataFrame:
        counts = df.groupBy("cluster_id", c.alias("v")).agg(F.count("*").alias("n")).where("v is not null")
        return counts.groupBy("cluster_id").agg(F.max("n").alias(f"{name}_top_count"), F.sum("n").alias(f"__{name}_n"))

    submitters = F.count_distinct("submitter") if "submitter" in df.columns else F.lit(None).cast("long")
    # whole days between the times as they are: seconds cut off before the difference could count a day too many
    days = F.timestamp_diff("DAY", F.min("submit_time"), F.max("submit_time"))
    groups = df.groupBy("cluster_id").agg(F.count("*").alias("frequency"), F.greatest(days, F.when(days.isNotNull(), 1)).alias("span_days"), submitters.alias("unique_submitters"))
    out = groups.join(top("subject", subject), "cluster_id", "left").join(top("area", area), "cluster_id", "left")
    # hundredths of the double as it is; F.round takes the decimal it is shown as, so 1.005 would go up
    daily = F.coalesce(F.round(100 * (F.col("frequency") / F.col("span_days"))) / 100, F.lit(0.0))
    out = out.withColumn("daily_avg", daily)
    share = lambda x: F.coalesce(F.bround(100 * F.col(f"{x}_top_count") / F.col(f"__{x}_n")).cast("int"), F.lit(0))
    kind = F.when((F.col("unique_submitters") <= 2) & (F.col("frequency") >= 5), "同一人反复").when(F.col("unique_submitters") >= 10, "群体反映").when(F.col("unique_submitters").isNotNull(), "少数人")
    return out.select(
        "cluster_id", "frequency",
        F.coalesce(F.concat(F.col("span_days").cast("string"), F.lit(" 天")), F.lit("未知")).alias("span_days"), "daily_avg",
        F.when(F.col("daily_avg") >= 3, "高发").when(F.col("daily_avg") >= 1, "中频").otherwise("低频").alias("freq_level"),
        "unique_submitters", kind.alias("submitter_type"),
        *[c for x in ("subject", "area") for c in (F.coalesce(f"{x}_top_count", F.lit(0)).alias(f"{x}_top_count"), share(x).alias(f"{x}_concentration"), F.when(share(x) >= 80, "集中").otherwise("分散").alias(f"{x}_type"))],
    )


def event_profiles(df: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """Recurring groups by size, numbered EV001 on: subject label, type, area, times, first samples, measures.

    df is classified (classify_recurring) and has _seq. The largest groups are
    found by one aggregate; their tickets alone are written and measured.
    """
    multi = df.where("is_multi_freq")
    groups = multi.groupBy("cluster_id").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "cluster_id").limit(max_events)
    # at most max_events rows from here on, so numbering them in one task is bounded
    groups = written(groups.withColumn("__n", F.row_number().over(Window.orderBy(F.desc("frequency"), "cluster_id"))))
    needed = [c for c in ("cluster_id", "_seq", "order_id", "content", "submit_time", "submitter", "extracted_subject", "extracted_event", "extracted_area") if c in multi.columns]
    shown = written(multi.join(F.broadcast(groups.select("cluster_id")), "cluster_id", "left_semi").select(*needed))
    about = shown.groupBy("cluster_id").agg(F.count_distinct(filled(F.col("extracted_subject"))).alias("__subjects"), F.min("submit_time").alias("__first"), F.max("submit_time").alias("__last"))
    names = {f"__{x}": F.col(f"extracted_{x}") for x in ("subject", "event", "area")}
    groups = groups.join(about, "cluster_id").join(modes(shown, "cluster_id", names), "cluster_id", "left")
    ranked = shown.withColumn("__r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("_seq"))).where(F.col("__r") <= SAMPLES)
    one = F.struct("__r", "order_id", truncate(F.col("content"), SAMPLE_CHARS).alias("content"))
    samples = ranked.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["order_id"].alias("order_id"), x["content"].alias("content"))).alias("sample_orders"))
    measures = recurrence_metrics(shown)
    metrics = F.struct(*[c for c in measures.columns if c not in ("cluster_id", "frequency")]).alias("dedup_metrics")
    subject = F.when(F.col("__subjects") >= 3, F.concat(F.lit("多主体聚合（"), F.col("__subjects"), F.lit("处）"))).otherwise(F.coalesce("__subject", F.lit("（未识别主体）")))
    out = groups.join(samples, "cluster_id").join(measures.select("cluster_id", metrics), "cluster_id")
    return out.select(
        F.format_string("EV%03d", "__n").alias("event_id"), "cluster_id", subject.alias("event_subject"),
        F.coalesce("__event", F.lit("（未识别类型）")).alias("event_type"), F.coalesce("__area", F.lit("（未识别区域）")).alias("area"), "frequency",
        fmt_seen(F.col("__first"), "未知").alias("first_seen"), fmt_seen(F.col("__last"), "未知").alias("last_seen"), "sample_orders", "dedup_metrics",
    )


def peak_day(df: DataFrame) -> DataFrame:
    """Busiest day of each cluster: count and MM-dd, of equal days the earliest."""
    days = df.where("submit_time is not null").groupBy("cluster_id", F.to_date("submit_time").alias("day")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.datediff("day", F.lit("1970-01-01"))).alias("late"), "day"))
    return days.groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", F.col("b.n").alias("peak_day_count"), F.date_format("b.day", "MM-dd").alias("peak_day_date"))


def area_spread(df: DataFrame) -> DataFrame:
    """Different areas of each cluster, and the commonest."""
    area = filled(F.col("extracted_area"))
    counts = df.groupBy("cluster_id").agg(F.count_distinct(area).alias("area_count"))
    return counts.join(modes(df, "cluster_id", {"area_top_name": F.col("extracted_area")}), "cluster_id", "left").withColumn("area_top_name", F.coalesce("area_top_name", F.lit("")))


def recent_counts(df: DataFrame) -> DataFrame:
    """Tickets of each cluster in the last 24 hours and 7 days before the latest time of all."""
    last = df.agg(F.max("submit_time").alias("__last"))
    since = lambda interval: F.count_if(F.col("submit_time") >= F.col("__last") - F.expr(f"interval {interval}"))
    return df.crossJoin(F.broadcast(last)).groupBy("cluster_id").agg(since("24 hours").alias("last_24h"), since("7 days").alias("last_7d"))
