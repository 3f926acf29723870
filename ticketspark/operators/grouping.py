"""Grouping tickets into events by keys, merging groups, and the choice of a route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pack_zh as zh
from ..functions.extract import best_venue
from ..functions.text import any_of, apply_synonyms, blank, clean_title, filled, first_filled, has_any
from ..sources.written import drop, paths, written
from .recurrence import modes

MIN_COVERAGE = 0.3


def number_groups(df: DataFrame, key: Column, order: str = "_seq") -> DataFrame:
    """Add cluster_id: groups of equal key numbered from 0 by first appearance; -1 for a null key.

    Numbers come from counting groups by ranges of their first row: each range
    of about equal size numbers its own, and the sizes of earlier ranges are added.
    """
    df = df.withColumn("__key", key)
    firsts = df.where("__key is not null").groupBy("__key").agg(F.min(order).alias("__first"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = firsts.agg(F.max("__first").alias("__most"))
    ranged = firsts.crossJoin(F.broadcast(most)).withColumn("__part", F.floor(F.col("__first") * parts / (F.col("__most") + 1)))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # as many rows as partitions, so a window over all of them is small
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = counts.select("__part", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__first")) - 1
    ids = ranged.withColumn("__own", own).join(F.broadcast(starts), "__part").select("__key", (F.col("__own") + F.col("__before")).alias("cluster_id"))
    return df.join(ids, "__key", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)).cast("long")).drop("__key")


def subject_key(df: DataFrame) -> Column:
    """What a ticket is about: a specific subject, a venue of the address or content, an address with a landmark, community and building, community, town, else ''."""
    text = lambda c: blank(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    subject, address, community, building, content, town = map(text, ("extracted_subject", "addr_norm", "addr_community", "addr_building", "content", "extracted_area"))
    specific = F.when((F.length(subject) >= 2) & ~subject.rlike(f"(?:{any_of(zh.GENERIC_SUFFIX)})$"), subject)
    landmark = F.when((F.length(address) >= 4) & has_any(F.replace(address, F.lit("街道"), F.lit("")), zh.LANDMARKS), address)
    place = F.when((community != "") & (building != ""), F.concat(community, building))
    return first_filled(specific, best_venue(address), best_venue(content), landmark, place, community, town)


def event_subject_groups(df: DataFrame, synonyms: Sequence[tuple[str, str]] = (), systemic: Sequence[str] = tuple(zh.SYSTEMIC_EVENTS), subject: Column | None = None) -> DataFrame:
    """The main grouping: equal event (cleaned title, or the event type if no title is filled) and equal subject key.

    Systemic events and tickets without a subject key are grouped by event
    alone; without an event a ticket is in no group. A blank extracted_event is filled.
    """
    titled = df.agg(F.coalesce(F.bool_or(clean_title(F.coalesce("title", F.lit(""))) != ""), F.lit(False)).alias("__titled"))
    df = df.crossJoin(F.broadcast(titled))
    event = F.when(F.col("__titled"), clean_title(F.coalesce("title", F.lit("")))).otherwise(blank(F.coalesce("extracted_event", F.lit(""))))
    event = apply_synonyms(event, synonyms)
    about = apply_synonyms(subject_key(df) if subject is None else subject, synonyms)
    df = df.withColumns({"__event": event, "__about": about})
    alone = F.col("__event").isin(list(systemic)) | (F.col("__about") == "")
    key = F.when(F.col("__event") != "", F.when(alone, F.col("__event")).otherwise(F.concat_ws("|", "__event", "__about")))
    out = number_groups(df, key)
    return out.withColumn("extracted_event", first_filled(blank(F.col("extracted_event")), F.col("__event"))).drop("__titled", "__event", "__about")


def title_groups(df: DataFrame) -> DataFrame:
    return number_groups(df, filled(clean_title(F.coalesce("title", F.lit("")))))


def rule_groups(df: DataFrame) -> DataFrame:
    """Equal subject, event and area; none if all three are blank."""
    parts = [F.coalesce(F.col(f"extracted_{x}"), F.lit("")) for x in ("subject", "event", "area")]
    some = F.concat_ws("", *[F.trim(p) for p in parts]) != ""
    return number_groups(df, F.when(some, F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]))))


def cluster_modes(df: DataFrame) -> DataFrame:
    """(cluster_id, subject, event, area): commonest values of each group, '' if blank; -1 is left out."""
    inside = df.where("cluster_id <> -1")
    names = {x: F.col(f"extracted_{x}") for x in ("subject", "event", "area")}
    found = inside.select("cluster_id").distinct().join(modes(inside, "cluster_id", names), "cluster_id", "left")
    return found.select("cluster_id", *[F.coalesce(x, F.lit("")).alias(x) for x in names])


def consolidate_subjects(df: DataFrame) -> DataFrame:
    """Merge groups with equal commonest subject and compatible event into the lowest, as one pass in order of number would.

    In that pass each group not merged yet takes all later ones whose event is equal or
    blank, or all if its own is blank. So if a subject's lowest group has no event, all
    join it; else blank ones join the lowest, and others the lowest of their event.
    """
    groups = cluster_modes(df).where("subject <> ''").select("cluster_id", "subject", "event")
    lowest = groups.groupBy("subject").agg(F.min("cluster_id").alias("lowest"), F.min_by("event", "cluster_id").alias("first"))
    by_event = groups.groupBy("subject", "event").agg(F.min("cluster_id").alias("of_event"))
    head = F.when((F.col("first") == "") | (F.col("event") == ""), F.col("lowest")).otherwise(F.col("of_event"))
    heads = groups.join(lowest, "subject").join(by_event, ["subject", "event"]).select("cluster_id", head.alias("head")).where("head <> cluster_id")
    return df.join(heads, "cluster_id", "left").withColumn("cluster_id", F.coalesce("head", "cluster_id")).drop("head")


def recover_noise(df: DataFrame) -> DataFrame:
    """Tickets in no group join the lowest group whose commonest event and area they have."""
    signs = cluster_modes(df).where("event <> '' and area <> ''").groupBy(F.col("event").alias("__e"), F.col("area").alias("__a")).agg(F.min("cluster_id").alias("__to"))
    mine = (F.trim("extracted_event") == F.col("__e")) & (F.trim("extracted_area") == F.col("__a")) & (F.col("cluster_id") == -1)
    return df.join(signs, mine, "left").withColumn("cluster_id", F.coalesce("__to", "cluster_id")).drop("__e", "__a", "__to")


def consolidate(df: DataFrame) -> DataFrame:
    return recover_noise(consolidate_subjects(df))


def merge_by_signature(df: DataFrame) -> DataFrame:
    """Merge groups with equal commonest event and area, neither blank, into the lowest."""
    modes = cluster_modes(df).where("event <> '' and area <> ''")
    heads = modes.withColumn("head", F.min("cluster_id").over(Window.partitionBy("event", "area"))).select("cluster_id", "head")
    return df.join(heads, "cluster_id", "left").withColumn("cluster_id", F.coalesce("head", "cluster_id")).drop("head")


def merge_candidates(df: DataFrame, max_pairs: int = 30) -> DataFrame:
    """Pairs (big, small) of groups of one subject and area: the largest with each other, in order of subject, area and size."""
    sizes = df.where("cluster_id >= 0").groupBy(blank(F.col("extracted_subject")).alias("subject"), blank(F.col("extracted_area")).alias("area"), "cluster_id").agg(F.count("*").alias("n")).where("subject <> ''")
    first = sizes.groupBy("subject", "area").agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("big"), F.count("*").alias("groups")).where("groups > 1")
    pairs = sizes.join(first, ["subject", "area"]).where("cluster_id <> big")
    return pairs.orderBy("subject", "area", F.desc("n"), "cluster_id").limit(max_pairs).select("subject", "area", "big", F.col("cluster_id").alias("small"), F.col("n").alias("small_size"))


def first_contents(df: DataFrame, n: int = 2) -> DataFrame:
    """(cluster_id, place, content): the first n contents of each group by _seq, which a judge of merges is shown."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_seq"))
    return df.where("cluster_id >= 0").withColumn("place", place).where(F.col("place") <= n).select("cluster_id", "place", "content")


def candidate_contents(pairs: DataFrame, df: DataFrame, n: int = 2) -> DataFrame:
    """merge_candidates with the first contents of both groups as lists."""
    lists = first_contents(df, n).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]).alias("contents"))
    side = lambda k: lists.select(F.col("cluster_id").alias(k), F.col("contents").alias(f"{k}_contents"))
    return pairs.join(side("big"), "big").join(side("small"), "small")


def ends_of(links: DataFrame) -> DataFrame:
    """(node, head) of links (node, to), one for each node: where the chain ends, or the least node of the cycle it ends in.

    Each round doubles how far a node sees and is written, so a chain of n links
    takes about log2(n) rounds, each with a plan of the same size. It ends when a
    round neither lets fewer different nodes be seen, which then are ends or
    lie on cycles, nor lowers the least node seen on the way.
    """
    spark = links.sparkSession
    links = written(links.select("node", "to").where("node <> to"))
    hops = written(links.select("node", "to", F.least("node", "to").alias("low"), F.lit(True).alias("lower")))
    seen = hops.select("to").distinct().count()
    while seen:
        nxt = hops.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        low = F.least("low", F.coalesce("low2", "low"))
        further = hops.join(nxt, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), low.alias("low"), (low < F.col("low")).alias("lower"))
        earlier, hops = paths()[-1], written(further)
        drop(spark, [earlier])
        now, lower = hops.agg(F.count_distinct("to"), F.coalesce(F.bool_or("lower"), F.lit(False))).first()
        if now == seen and not lower:
            break
        seen = now
    # a node that is still linked on lies on a cycle, and has seen all of it
    cycle = hops.select(F.col("node").alias("to"), F.col("low").alias("cycle_low"))
    return hops.join(cycle, "to", "left").select("node", F.coalesce("cycle_low", "to").alias("head"))


def merge_by_verdict(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Merge small into big where a verdict (small, big, same, _seq) says same; the last verdict on a small counts, and chains are followed.

    A cycle, and what leads into it, ends at the cycle's lowest group.
    """
    step = verdicts.where("same").groupBy(F.col("small").alias("node")).agg(F.max_by("big", "_seq").alias("to"))
    heads = ends_of(step).withColumnRenamed("node", "cluster_id")
    return df.join(heads, "cluster_id", "left").withColumn("cluster_id", F.coalesce("head", "cluster_id")).drop("head")


def coverage(df: DataFrame) -> DataFrame:
    """One row: groups, share of tickets in one, tickets in none."""
    inside = F.count_if(F.col("cluster_id") != -1)
    return df.agg(
        F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"),
        F.coalesce(F.try_divide(inside, F.count("*")), F.lit(0.0)).alias("coverage"),
        F.count_if(F.col("cluster_id") == -1).alias("noise"),
    )


def quality_gate(df: DataFrame) -> tuple[DataFrame, bool]:
    """df's groups, or rule groups if there are none, too few tickets are in one, or there are too many; then consolidated. Also whether df's were taken."""
    n = df.count()
    row = coverage(df).first()
    good = row["clusters"] > 0 and row["coverage"] >= MIN_COVERAGE and row["clusters"] <= max(3, n / 2)
    return consolidate(df if good else rule_groups(df.drop("cluster_id"))), good


def cluster_tickets(df: DataFrame, synonyms: Sequence[tuple[str, str]] = (), density=None) -> tuple[DataFrame, dict]:
    """The route: key grouping if there is a title column or any event, else density groups (a function of df) behind the quality gate."""
    keyed = "title" in df.columns or df.where(filled(F.col("extracted_event")).isNotNull()).limit(1).count() > 0
    if keyed or density is None:
        out, good, method = event_subject_groups(df if "title" in df.columns else df.withColumn("title", F.lit("")), synonyms), True, "keys"
    else:
        out, good = quality_gate(density(df))
        method = "density" if good else "rules"
    row = coverage(out).first()
    return out, {"method": method, "clusters": row["clusters"], "coverage": row["coverage"], "noise": row["noise"]}
