"""The driver's tables in the roles of ticket tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import event_subject_groups
from ..operators.recurrence import classify_recurring, event_profiles
from ..sources.written import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their customer, nation and region, as tickets."""
    e, c, n, r = (table(spark, sf_dir, t) for t in ("events", "customer", "nation", "region"))
    j = e.join(c, e.user_id == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        F.col("event_id").cast("string").alias("order_id"), F.concat_ws(" ", "event_type", F.lit("by"), "c_name", F.lit("in"), "n_name", "props").alias("content"),
        F.col("event_type").alias("title"), F.col("c_name").alias("subject"), F.col("n_name").alias("area"), F.col("ts").alias("submit_time"), F.col("user_id").alias("submitter"),
        F.col("event_id").alias("_seq"), F.col("r_name").alias("town"), F.col("n_name").alias("community"), F.col("c_mktsegment").alias("segment"), "value",
        F.col("c_name").alias("extracted_subject"), F.col("event_type").alias("extracted_event"), F.col("n_name").alias("extracted_area"), F.lower("event_type").alias("normalized_content"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_subject_groups(event_tickets(spark, sf_dir), subject=F.col("extracted_subject"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_recurring(grouped(spark, sf_dir))


def classified_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classified tickets and their profiles; the tickets are worked out once and written."""
    c = written(classified(spark, sf_dir))
    return c, event_profiles(c)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_profiles(spark, sf_dir)[1]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event tickets under the names of the cleaned table."""
    t = event_tickets(spark, sf_dir)
    return t.select(
        F.col("order_id").alias("ticket_no"), F.concat(F.lit("job"), F.col("_seq") % 3).alias("job_id"), F.col("segment").alias("organization"), "town", "community",
        F.concat("town", F.lit("/"), "community").alias("address_normalized"), F.col("title").alias("event_type"), F.when(F.col("value") > 20, "refund").otherwise("").alias("request"),
        F.col("content").alias("raw_content"), F.lower("content").alias("clean_content"), F.lit("").alias("semantic_content"), (F.col("value") > 5).alias("is_usable"),
        F.when(F.col("value") < 1, "failed").otherwise("success").alias("parse_status"), "_seq",
    )


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the nations with an even key."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    return n.select(F.col("n_name").alias("area"), (F.col("n_nationkey") * 1.5).cast("double").alias("lat"), (100 + F.col("n_nationkey")).cast("double").alias("lon"))


T = """t AS (
  SELECT CAST(event_id AS VARCHAR) AS order_id, event_type || ' by ' || c_name || ' in ' || n_name || ' ' || props AS content, event_type AS title, c_name AS subject, n_name AS area, ts AS submit_time,
    user_id AS submitter, event_id AS _seq, r_name AS town, n_name AS community, c_mktsegment AS segment, value,
    c_name AS extracted_subject, event_type AS extracted_event, n_name AS extracted_area, lower(event_type) AS normalized_content
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
G = T + """, keys AS (SELECT title, subject, row_number() OVER (ORDER BY min(_seq)) - 1 AS cluster_id FROM t GROUP BY title, subject),
g AS (SELECT t.*, cluster_id FROM t JOIN keys USING (title, subject))"""
# every group has one subject, event and area, so its commonest values are any of them
C = G + """, c AS (
  SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, count(*) OVER (PARTITION BY cluster_id) >= 3 AS is_multi_freq,
    extracted_subject AS cluster_subject, extracted_event AS cluster_event, extracted_area AS cluster_area FROM g
)"""
SEEN = "CASE WHEN hour({0}) = 0 AND minute({0}) = 0 THEN strftime({0}, '%Y-%m-%d') ELSE strftime({0}, '%Y-%m-%d %H:%M') END"
E = C + f""", sizes AS (SELECT cluster_id, count(*) AS frequency, min(submit_time) AS a, max(submit_time) AS b, any_value(extracted_subject) AS event_subject, any_value(extracted_event) AS event_type, any_value(extracted_area) AS area
  FROM c WHERE is_multi_freq GROUP BY cluster_id ORDER BY frequency DESC, cluster_id LIMIT 500),
e AS (SELECT 'EV' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS event_id, cluster_id, event_subject, event_type, area, frequency, {SEEN.format('a')} AS first_seen, {SEEN.format('b')} AS last_seen
  FROM (SELECT *, row_number() OVER (ORDER BY frequency DESC, cluster_id) AS n FROM sizes))"""
K = T + """, k AS (
  SELECT order_id AS ticket_no, 'job' || CAST(_seq % 3 AS VARCHAR) AS job_id, segment AS organization, town, community, town || '/' || community AS address_normalized, title AS event_type,
    CASE WHEN value > 20 THEN 'refund' ELSE '' END AS request, content AS raw_content, lower(content) AS clean_content, '' AS semantic_content, value > 5 AS is_usable,
    CASE WHEN value < 1 THEN 'failed' ELSE 'success' END AS parse_status, _seq FROM t
)"""
X = "x AS (SELECT n_name AS area, CAST(n_nationkey * 1.5 AS DOUBLE) AS lat, CAST(100 + n_nationkey AS DOUBLE) AS lon FROM nation WHERE n_nationkey % 2 = 0)"
