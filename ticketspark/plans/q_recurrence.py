"""Queries of grouping, recurrence, profiles and roll-ups over the event tickets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grouping, recurrence, rollups, search
from .bindings import C, E, G, K, T, X, classified, classified_profiles, cleaned, coords, event_tickets, grouped, profiles, table
from .registry import ORACLE_SQL, query

PROFILE = ["event_id", "cluster_id", "event_subject", "event_type", "area", "frequency", "first_seen", "last_seen"]
DAYS = "greatest(CAST(floor(epoch(max(submit_time) - min(submit_time)) / 86400) AS BIGINT), 1)"

METRICS_SQL = f"""WITH {C}, m AS (
  SELECT cluster_id, count(*) AS n, {DAYS} AS d, count(DISTINCT submitter) AS u, count(extracted_subject) AS s, count(extracted_area) AS a FROM c WHERE is_multi_freq GROUP BY cluster_id
)
SELECT cluster_id, n AS frequency, CAST(d AS VARCHAR) || ' 天' AS span_days, round(n / d, 2) AS daily_avg, CASE WHEN round(n / d, 2) >= 3 THEN '高发' WHEN round(n / d, 2) >= 1 THEN '中频' ELSE '低频' END AS freq_level,
  u AS unique_submitters, CASE WHEN u <= 2 AND n >= 5 THEN '同一人反复' WHEN u >= 10 THEN '群体反映' ELSE '少数人' END AS submitter_type,
  s AS subject_top_count, 100 AS subject_concentration, '集中' AS subject_type, a AS area_top_count, 100 AS area_concentration, '集中' AS area_type
FROM m"""


@query("a4_event_profiles", f"""WITH {E}, s AS (SELECT cluster_id, order_id, CASE WHEN length(content) <= 80 THEN content ELSE content[1:80] || '…' END AS content, row_number() OVER (PARTITION BY cluster_id ORDER BY _seq) AS r FROM c)
SELECT e.*, list({{'order_id': s.order_id, 'content': s.content}} ORDER BY r) AS sample_orders FROM e JOIN s ON e.cluster_id = s.cluster_id AND r <= 8 GROUP BY ALL""")
def a4(spark, sf):
    return profiles(spark, sf).select(*PROFILE, "sample_orders")


@query("g3_event_subject_groups", f"WITH {G} SELECT order_id, cluster_id, extracted_event FROM g")
def g3(spark, sf):
    return grouped(spark, sf).select("order_id", "cluster_id", "extracted_event")


@query("g4_title_groups", f"WITH {T}, k AS (SELECT title, row_number() OVER (ORDER BY min(_seq)) - 1 AS cluster_id FROM t GROUP BY title) SELECT order_id, cluster_id FROM t JOIN k USING (title)")
def g4(spark, sf):
    return grouping.title_groups(event_tickets(spark, sf)).select("order_id", "cluster_id")


@query("g5_rule_groups", f"WITH {T}, k AS (SELECT subject, title, area, row_number() OVER (ORDER BY min(_seq)) - 1 AS cluster_id FROM t GROUP BY ALL) SELECT order_id, cluster_id FROM t JOIN k USING (subject, title, area)")
def g5(spark, sf):
    return grouping.rule_groups(event_tickets(spark, sf)).select("order_id", "cluster_id")


@query("g6_consolidate_subjects", f"WITH {T}, k AS (SELECT title, subject, submitter % 2 AS half, dense_rank() OVER (ORDER BY title, area, submitter) AS cluster_id, area FROM t), h AS (SELECT subject, title, min(cluster_id) AS head FROM k GROUP BY ALL) SELECT order_id, head AS cluster_id FROM t JOIN h USING (subject, title)")
def g6(spark, sf):
    t = event_tickets(spark, sf)
    keys = t.select("title", "area", "submitter").distinct()
    numbered = keys.withColumn("cluster_id", F.dense_rank().over(Window.orderBy("title", "area", "submitter")).cast("long"))
    return grouping.consolidate_subjects(t.join(numbered, ["title", "area", "submitter"])).select("order_id", "cluster_id")


@query("g7_recover_noise", f"""WITH {T}, k AS (SELECT *, CASE WHEN value > 30 THEN -1 ELSE submitter END AS cid FROM t),
m AS (SELECT DISTINCT cid, area FROM k WHERE cid <> -1),
counts AS (SELECT cid, title, count(*) AS n FROM k WHERE cid <> -1 GROUP BY ALL),
best AS (SELECT cid, title FROM counts QUALIFY row_number() OVER (PARTITION BY cid ORDER BY n DESC, title) = 1),
sig AS (SELECT title, area, min(cid) AS head FROM best JOIN m USING (cid) GROUP BY ALL)
SELECT order_id, CASE WHEN cid = -1 THEN coalesce(head, -1) ELSE cid END AS cluster_id FROM k LEFT JOIN sig ON k.title = sig.title AND k.area = sig.area""")
def g7(spark, sf):
    t = event_tickets(spark, sf).withColumn("cluster_id", F.when(F.col("value") > 30, -1).otherwise(F.col("submitter")).cast("long"))
    return grouping.recover_noise(t).select("order_id", "cluster_id")


@query("g8_merge_by_signature", f"""WITH {T}, counts AS (SELECT submitter, title, area, count(*) AS n FROM t GROUP BY ALL),
best AS (SELECT submitter, title, area FROM counts QUALIFY row_number() OVER (PARTITION BY submitter ORDER BY n DESC, title) = 1),
heads AS (SELECT submitter, min(submitter) OVER (PARTITION BY title, area) AS head FROM best)
SELECT order_id, head AS cluster_id FROM t JOIN heads USING (submitter)""")
def g8(spark, sf):
    return grouping.merge_by_signature(event_tickets(spark, sf).withColumn("cluster_id", F.col("submitter"))).select("order_id", "cluster_id")


CAND = f"""WITH {T}, q AS (SELECT segment AS s, area AS a, title, dense_rank() OVER (ORDER BY title, segment, area) AS cluster_id, count(*) AS n FROM t GROUP BY segment, area, title),
r AS (SELECT *, row_number() OVER (PARTITION BY s, a ORDER BY n DESC, cluster_id) AS p, first_value(cluster_id) OVER (PARTITION BY s, a ORDER BY n DESC, cluster_id) AS big FROM q)"""


def _segment_groups(spark, sf):
    t = event_tickets(spark, sf).withColumn("extracted_subject", F.col("segment"))
    keys = t.groupBy("title", "segment", "area").agg(F.count("*").alias("n"))
    numbered = keys.withColumn("cluster_id", F.dense_rank().over(Window.orderBy("title", "segment", "area")).cast("long")).drop("n")
    return t.join(numbered, ["title", "segment", "area"])


@query("g20_merge_candidates", CAND + " SELECT s AS subject, a AS area, big, cluster_id AS small, n AS small_size FROM r WHERE p > 1 ORDER BY s, a, n DESC, cluster_id LIMIT 30")
def g20(spark, sf):
    return grouping.merge_candidates(_segment_groups(spark, sf))


@query("w8_first_contents", f"WITH {G}, r AS (SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY _seq) AS INTEGER) AS place, content FROM g) SELECT * FROM r WHERE place <= 2")
def w8(spark, sf):
    return grouping.first_contents(grouped(spark, sf))


@query("w8_candidate_contents", CAND + """, f AS (SELECT q.cluster_id, content, row_number() OVER (PARTITION BY q.cluster_id ORDER BY _seq) AS place FROM t JOIN q ON q.s = segment AND q.a = t.area AND q.title = t.title),
l AS (SELECT cluster_id, list(content ORDER BY place) AS x FROM f WHERE place <= 2 GROUP BY cluster_id), c AS (SELECT s AS subject, a AS area, big, cluster_id AS small, n AS small_size FROM r WHERE p > 1 ORDER BY s, a, n DESC, cluster_id LIMIT 30)
SELECT c.*, lb.x AS big_contents, ls.x AS small_contents FROM c JOIN l AS lb ON lb.cluster_id = big JOIN l AS ls ON ls.cluster_id = small""")
def w8_pairs(spark, sf):
    df = _segment_groups(spark, sf)
    return grouping.candidate_contents(grouping.merge_candidates(df), df)


@query("g21_merge_by_verdict", CAND + """, v AS (SELECT cluster_id AS small, big FROM r WHERE p > 1 AND cluster_id % 2 = 0)
SELECT order_id, coalesce(v.big, q.cluster_id) AS cluster_id FROM t JOIN q ON q.s = segment AND q.a = t.area AND q.title = t.title LEFT JOIN v ON v.small = q.cluster_id""")
def g21(spark, sf):
    df = _segment_groups(spark, sf)
    pairs = grouping.merge_candidates(df, 1_000_000)
    verdicts = pairs.select("small", "big", (F.col("small") % 2 == 0).alias("same"), F.col("small").alias("_seq"))
    return grouping.merge_by_verdict(df, verdicts).select("order_id", "cluster_id")


# each event group is said to be the same as the next lower one of its subject, as W7's judge may say: one chain for each subject
@query("w7_verdict_chains", CAND + """, v AS (SELECT s, a, cluster_id, first_value(cluster_id) OVER (PARTITION BY s ORDER BY cluster_id) AS head FROM q) SELECT order_id, v.head AS cluster_id FROM t JOIN v ON v.s = segment AND v.a = t.area JOIN q ON q.cluster_id = v.cluster_id AND q.title = t.title""")
def w7_chains(spark, sf):
    df = _segment_groups(spark, sf)
    groups = df.select("segment", "cluster_id").distinct()
    lower = groups.withColumn("big", F.lag("cluster_id").over(Window.partitionBy("segment").orderBy("cluster_id"))).where("big is not null")
    verdicts = lower.select(F.col("cluster_id").alias("small"), "big", F.lit(True).alias("same"), F.col("cluster_id").alias("_seq"))
    return grouping.merge_by_verdict(df, verdicts).select("order_id", "cluster_id")


@query("g22_cluster_tickets", f"WITH {G} SELECT order_id, cluster_id FROM g")
def g22(spark, sf):
    return grouping.cluster_tickets(event_tickets(spark, sf).drop("content", "extracted_area", "community", "town"))[0].select("order_id", "cluster_id")


@query("a1_cluster_size", f"WITH {G} SELECT order_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM g")
def a1(spark, sf):
    return recurrence.cluster_size(grouped(spark, sf)).select("order_id", "cluster_size")


@query("a2_group_mode", f"WITH {T}, n AS (SELECT submitter, title, count(*) AS n FROM t GROUP BY ALL) SELECT submitter, title AS mode FROM n QUALIFY row_number() OVER (PARTITION BY submitter ORDER BY n DESC, title) = 1")
def a2(spark, sf):
    return recurrence.group_mode(event_tickets(spark, sf), "submitter", "title")


@query("a3_classify_recurring", f"WITH {C} SELECT order_id, cluster_size, is_multi_freq, cluster_subject, cluster_event, cluster_area FROM c")
def a3(spark, sf):
    return classified(spark, sf).select("order_id", "cluster_size", "is_multi_freq", "cluster_subject", "cluster_event", "cluster_area")


@query("f6_without_noise", f"WITH {T}, k AS (SELECT *, CASE WHEN value > 30 THEN -1 ELSE submitter END AS cid FROM t) SELECT order_id, cid <> -1 AND count(*) OVER (PARTITION BY cid) >= 3 AS is_multi_freq, count(*) OVER (PARTITION BY cid) AS cluster_size FROM k")
def f6(spark, sf):
    t = event_tickets(spark, sf).withColumn("cluster_id", F.when(F.col("value") > 30, -1).otherwise(F.col("submitter")).cast("long"))
    return recurrence.classify_recurring(t).select("order_id", "is_multi_freq", "cluster_size")


@query("w3_first_samples", f"WITH {E}, r AS (SELECT cluster_id, order_id, row_number() OVER (PARTITION BY cluster_id ORDER BY _seq) AS r FROM c) SELECT event_id, order_id FROM e JOIN r USING (cluster_id) WHERE r <= 8")
def w3(spark, sf):
    return profiles(spark, sf).select("event_id", F.explode("sample_orders.order_id").alias("order_id"))


@query("w4_event_numbers", f"WITH {E} SELECT event_id, cluster_id, frequency FROM e")
def w4(spark, sf):
    return profiles(spark, sf).select("event_id", "cluster_id", "frequency")


@query("w9_first_appearance", f"WITH {T}, k AS (SELECT area, segment, row_number() OVER (ORDER BY min(_seq)) - 1 AS cluster_id FROM t GROUP BY ALL) SELECT order_id, cluster_id FROM t JOIN k USING (area, segment)")
def w9(spark, sf):
    t = event_tickets(spark, sf)
    return grouping.number_groups(t, F.concat_ws("|", "area", "segment")).select("order_id", "cluster_id")


@query("a5_recurrence_metrics", METRICS_SQL)
def a5(spark, sf):
    return recurrence.recurrence_metrics(classified(spark, sf).where("is_multi_freq"))


@query("a6_peak_day", f"WITH {G}, d AS (SELECT cluster_id, CAST(submit_time AS DATE) AS day, count(*) AS n FROM g GROUP BY ALL) SELECT cluster_id, n AS peak_day_count, strftime(day, '%m-%d') AS peak_day_date FROM d QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, day) = 1")
def a6(spark, sf):
    return recurrence.peak_day(grouped(spark, sf))


@query("a7_area_spread", f"WITH {T}, n AS (SELECT segment, area, count(*) AS n FROM t GROUP BY ALL) SELECT dense_rank() OVER (ORDER BY segment) AS cluster_id, count(*) AS area_count, (list(area ORDER BY n DESC, area))[1] AS area_top_name FROM n GROUP BY segment")
def a7(spark, sf):
    t = event_tickets(spark, sf)
    ids = t.select("segment").distinct().withColumn("cluster_id", F.dense_rank().over(Window.orderBy("segment")))
    return recurrence.area_spread(t.join(F.broadcast(ids), "segment"))


@query("a8_daily_counts", f"WITH {T} SELECT strftime(submit_time, '%Y-%m-%d') AS day, count(*) AS n FROM t GROUP BY ALL")
def a8(spark, sf):
    return rollups.daily_counts(event_tickets(spark, sf))


@query("a9_daily_counts_by_area", f"WITH {T}, {X} SELECT extracted_area, strftime(submit_time, '%Y-%m-%d') AS day, count(*) AS n FROM t SEMI JOIN x ON x.area = t.area GROUP BY ALL")
def a9(spark, sf):
    return rollups.daily_counts_by_area(event_tickets(spark, sf), coords(spark, sf))


@query("a10_event_area_counts", f"WITH {G}, {X}, n AS (SELECT cluster_id, area, count(*) AS n FROM g GROUP BY ALL) SELECT n.*, lat, lon FROM n LEFT JOIN x USING (area)")
def a10(spark, sf):
    return rollups.event_area_counts(grouped(spark, sf), coords(spark, sf))


@query("a11_kpis", f"""WITH {E} SELECT count(*) AS total_orders, count(DISTINCT CASE WHEN is_multi_freq THEN cluster_id END) AS multi_events, count(DISTINCT extracted_subject) AS total_subjects,
count(DISTINCT extracted_event) AS total_events, (SELECT event_subject FROM e ORDER BY frequency DESC, cluster_id LIMIT 1) AS biggest_event FROM c""")
def a11(spark, sf):
    return rollups.kpis(*classified_profiles(spark, sf))


@query("a12_area_overview", f"""WITH {E}, {X}, l AS (SELECT c.area, cluster_id, count(*) AS f FROM c WHERE is_multi_freq GROUP BY ALL),
n AS (SELECT l.area, event_id, event_subject || ' · ' || event_type AS name, f, row_number() OVER (PARTITION BY l.area ORDER BY f DESC, event_id) AS r FROM l JOIN e USING (cluster_id)),
b AS (SELECT area, list({{'event_id': event_id, 'name': name, 'frequency': f}} ORDER BY r) AS top_events FROM n WHERE r <= 5 GROUP BY area)
SELECT c.area, count(*) AS total, count_if(is_multi_freq) AS multi, lat, lon, any_value(top_events) AS top_events FROM c JOIN x USING (area) LEFT JOIN b USING (area) GROUP BY c.area, lat, lon""")
def a12(spark, sf):
    return rollups.area_overview(*classified_profiles(spark, sf), coords(spark, sf))


@query("a13_overview", f"WITH {C} SELECT count(*) AS n_rows, strftime(min(submit_time), '%Y-%m-%d') AS time_min, strftime(max(submit_time), '%Y-%m-%d') AS time_max, count_if(is_multi_freq) AS multi_orders FROM c")
def a13(spark, sf):
    return rollups.overview(*classified_profiles(spark, sf), coords(spark, sf))["source"]


@query("a14_top_subjects", f"WITH {T} SELECT subject, count(*) AS n FROM t GROUP BY subject ORDER BY n DESC, subject LIMIT 30")
def a14(spark, sf):
    return rollups.top_subjects(event_tickets(spark, sf))


@query("a15_top_categories", f"WITH {T} SELECT extracted_event AS category, count(*) AS n FROM t GROUP BY ALL ORDER BY n DESC, category LIMIT 30")
def a15(spark, sf):
    return rollups.top_categories(event_tickets(spark, sf))


def _overview_part(name: str, part: str, sql: str) -> None:
    """One of the tables of the overview, which must be that of the query for it alone."""

    @query(name, sql)
    def run(spark, sf):
        return rollups.overview(*classified_profiles(spark, sf), coords(spark, sf))[part]


for _part, _alone in (("areas", "a12_area_overview"), ("daily", "a8_daily_counts"), ("daily_by_area", "a9_daily_counts_by_area"), ("subjects", "a14_top_subjects"), ("categories", "a15_top_categories")):
    _overview_part(f"a13_overview_{_part}", _part, ORACLE_SQL[_alone])


@query("a16_group_by_organization", f"WITH {K} SELECT organization, count(*) AS ticket_count, list(ticket_no ORDER BY ticket_no) AS ticket_nos FROM k GROUP BY organization ORDER BY ticket_count DESC, organization LIMIT 200")
def a16(spark, sf):
    return rollups.group_by_organization(cleaned(spark, sf))


@query("a17_group_by_address", f"WITH {K} SELECT town, community, count(*) AS ticket_count, list(ticket_no ORDER BY ticket_no) AS ticket_nos FROM k GROUP BY town, community HAVING count(*) >= 20 ORDER BY ticket_count DESC, town, community LIMIT 200")
def a17(spark, sf):
    return rollups.group_by_address(cleaned(spark, sf), "community", min_count=20)


@query("a16_group_members", f"WITH {K}, b AS (SELECT organization, count(*) AS ticket_count FROM k GROUP BY organization ORDER BY ticket_count DESC, organization LIMIT 200) SELECT organization, ticket_count, ticket_no FROM k JOIN b USING (organization)")
def a16_members(spark, sf):
    return rollups.group_members(cleaned(spark, sf), ["organization"])


@query("a17_group_members", f"WITH {K}, b AS (SELECT town, community, count(*) AS ticket_count FROM k GROUP BY ALL HAVING count(*) >= 20 ORDER BY ticket_count DESC, town, community LIMIT 200) SELECT town, community, ticket_count, ticket_no FROM k JOIN b USING (town, community)")
def a17_members(spark, sf):
    return rollups.group_members(cleaned(spark, sf), ["town", "community"], min_count=20)


@query("a18_town_tree", f"""WITH {K}, i AS (SELECT town, community, count(*) AS n FROM k GROUP BY ALL), o AS (SELECT town, count(*) AS ticket_count FROM k GROUP BY town)
SELECT town, any_value(ticket_count) AS ticket_count, list({{'name': community, 'n': n}} ORDER BY n DESC, community) AS children FROM o JOIN i USING (town) GROUP BY town""")
def a18(spark, sf):
    return rollups.town_tree(cleaned(spark, sf))


@query("a19_list_event_types", f"WITH {K} SELECT event_type AS name, count(*) AS n FROM k GROUP BY ALL")
def a19(spark, sf):
    return rollups.list_values(cleaned(spark, sf), "event_type")


@query("a19_list_towns", f"WITH {K} SELECT town AS name, count(*) AS n FROM k GROUP BY ALL")
def a19_towns(spark, sf):
    return rollups.list_values(cleaned(spark, sf), "town")


@query("a20_job_stats", f"""WITH {K} SELECT job_id, count(*) AS total, count_if(is_usable) AS usable, count_if(parse_status = 'failed') AS failed, round_even(count_if(organization <> '') / count(*), 4) AS organization_rate,
round_even(count_if(address_normalized <> '') / count(*), 4) AS address_normalized_rate, round_even(count_if(event_type <> '') / count(*), 4) AS event_type_rate, round_even(count_if(request <> '') / count(*), 4) AS request_rate FROM k WHERE job_id = 'job1' GROUP BY job_id""")
def a20(spark, sf):
    return rollups.job_stats(cleaned(spark, sf).where("job_id = 'job1'")).withColumn("job_id", F.lit("job1"))


@query("a21_coverage", f"WITH {T}, k AS (SELECT CASE WHEN value > 30 THEN -1 ELSE submitter END AS cid FROM t) SELECT count(DISTINCT CASE WHEN cid <> -1 THEN cid END) AS clusters, count_if(cid <> -1) / count(*) AS coverage, count_if(cid = -1) AS noise FROM k")
def a21(spark, sf):
    return grouping.coverage(event_tickets(spark, sf).withColumn("cluster_id", F.when(F.col("value") > 30, -1).otherwise(F.col("submitter"))))


@query("a22_hit_rates", f"WITH {T} SELECT count_if(value > 10) / count(*) AS subject_rate, 1e0 AS event_rate, 1e0 AS area_rate FROM t")
def a22(spark, sf):
    return rollups.hit_rates(event_tickets(spark, sf).withColumn("extracted_subject", F.when(F.col("value") > 10, F.col("subject")).otherwise(" ")))


GOLD = """gold AS (SELECT CAST(doc_id AS VARCHAR) AS id_a, CAST(doc_id + 1 AS VARCHAR) AS id_b, quality AS label, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS category FROM labels),
cl AS (SELECT CAST(doc_id AS VARCHAR) AS order_id, CASE WHEN n_chars < 200 THEN -1 ELSE n_chars // 2000 END AS cluster_id FROM documents),
p AS (SELECT gold.*, a.cluster_id AS ca, b.cluster_id AS cb FROM gold JOIN cl AS a ON a.order_id = id_a JOIN cl AS b ON b.order_id = id_b),
s AS (SELECT *, ca = cb AND ca <> -1 AS said, label = 1 AS truth FROM p)"""


def _gold(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    gold = labels.select(F.col("doc_id").cast("string").alias("id_a"), (F.col("doc_id") + 1).cast("string").alias("id_b"), F.col("quality").alias("label"), F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias("category"))
    clusters = docs.select(F.col("doc_id").cast("string").alias("order_id"), F.when(F.col("n_chars") < 200, -1).otherwise(F.floor(F.col("n_chars") / 2000)).cast("long").alias("cluster_id"))
    return gold, clusters


@query("a23_pair_eval", f"WITH {GOLD}, n AS (SELECT category, count_if(said AND truth) AS tp, count_if(said AND NOT truth) AS fp, count_if(NOT said AND truth) AS fn, count_if(NOT said AND NOT truth) AS tn FROM s GROUP BY category) SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM n")
def a23(spark, sf):
    return rollups.pair_eval(*_gold(spark, sf), "category")


@query("a23_wrong_pairs", f"WITH {GOLD} SELECT id_a, id_b, CASE WHEN said THEN '误并' ELSE '漏并' END AS error FROM s WHERE said <> truth")
def a23_wrong(spark, sf):
    return rollups.wrong_pairs(*_gold(spark, sf)).select("id_a", "id_b", "error")


@query("j9_gold_clusters", f"WITH {GOLD} SELECT id_a, id_b, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b FROM gold LEFT JOIN cl AS a ON a.order_id = id_a LEFT JOIN cl AS b ON b.order_id = id_b")
def j9(spark, sf):
    return rollups.gold_clusters(*_gold(spark, sf)).select("id_a", "id_b", "cluster_a", "cluster_b")


@query("u3_missing_gold", f"WITH {GOLD}, cc AS (SELECT * FROM cl WHERE CAST(order_id AS BIGINT) % 3 > 0) SELECT DISTINCT order_id FROM (SELECT id_a AS order_id FROM gold UNION SELECT id_b FROM gold) ANTI JOIN cc USING (order_id)")
def u3(spark, sf):
    gold, clusters = _gold(spark, sf)
    return rollups.missing_gold(gold, clusters.where(F.col("order_id").cast("long") % 3 > 0))


@query("a24_profile_input", f"WITH {T} SELECT title, count(*) AS n FROM t GROUP BY title ORDER BY n DESC, title LIMIT 20")
def a24(spark, sf):
    return rollups.profile_input(event_tickets(spark, sf))["titles"]


@query("a24_profile_times", f"WITH {T} SELECT count(submit_time) AS valid, min(submit_time) AS first, max(submit_time) AS last FROM t")
def a24_times(spark, sf):
    return rollups.profile_input(event_tickets(spark, sf))["times"]


@query("a25_recent_counts", f"WITH {G}, l AS (SELECT max(submit_time) AS m FROM g) SELECT cluster_id, count_if(submit_time >= m - INTERVAL 24 HOURS) AS last_24h, count_if(submit_time >= m - INTERVAL 7 DAYS) AS last_7d FROM g, l GROUP BY cluster_id")
def a25(spark, sf):
    return recurrence.recent_counts(grouped(spark, sf))


@query("a26_top_clusters", f"WITH {G} SELECT cluster_id, count(*) AS n, any_value(title) AS event, any_value(subject) AS subject, any_value(title) AS title FROM g GROUP BY cluster_id ORDER BY n DESC, cluster_id LIMIT 12")
def a26(spark, sf):
    return rollups.top_clusters(grouped(spark, sf))


@query("f5_having_min_count", f"WITH {T} SELECT submitter, count(*) AS n FROM t GROUP BY submitter HAVING count(*) >= 70")
def f5(spark, sf):
    return search.having_min_count(event_tickets(spark, sf), "submitter", 70)
