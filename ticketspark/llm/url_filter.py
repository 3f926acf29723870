"""URL filtering: host rules, and for the rest a Bloom filter cascade that is exact over the corpus's hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .scratch import keep
from .textops import U64, mix

#: Bits and hash functions for each key of a level.
BITS_EACH, HASHES = 10, 4
#: Keys of the universe in one shard of the cascade; a shard is built by one task.
SHARD_KEYS = 1 << 18
#: Cascade bytes that are broadcast at once; a larger cascade takes several scans, one after another.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without a url or ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without a url or ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest of rules (verdict, host, path) that fits, else null.

    A rule fits its host and all its subdomains, if the path starts with the
    rule's. Of equally long rules the longer host wins, then block.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    found = [F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    h = mix(h1 + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = mix(h2 ^ h) | U64(1)
    for _ in range(HASHES):
        yield (h % U64(size)).astype(np.int64)
        h = h + step


def _passes(level: np.ndarray, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for at in _bits(h1, h2, number, 8 * len(level)):
        ok &= (level[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[bytes]:
    """Levels for distinct keys given by two hashes: odd levels encode listed keys, even ones what the level before lets through wrongly."""
    inside, outside = listed, ~listed
    levels: list[bytes] = []
    while inside.any():
        level = np.zeros(BITS_EACH * int(inside.sum()) // 8 + 8, np.uint8)
        for at in _bits(h1[inside], h2[inside], len(levels), 8 * len(level)):
            np.bitwise_or.at(level, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        wrong = outside.copy()
        wrong[outside] = _passes(level, len(levels), h1[outside], h2[outside])
        levels.append(level.tobytes())
        inside, outside = wrong, inside
    return levels


def is_listed(levels: list[bytes], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: the first level that stops a key decides."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    left = np.arange(len(h1))
    for number, level in enumerate(levels):
        ok = _passes(np.frombuffer(level, np.uint8), number, h1[left], h2[left])
        out[left[~ok]] = number % 2 == 1
        left = left[ok]
    return out


def build_cascade(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Cascade over distinct keys (key, listed): rows (shard, levels), and the number of shards.

    Keys are dealt to shards by hash, about shard_keys to each, and each shard is
    a cascade of its own, so no task holds more than a shard.
    """
    total = keys.count()
    shards = max(1, -(-total // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy(np.int64).astype(U64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "levels": [build_levels(h1, h2, pdf["listed"].to_numpy(bool))]})

    hashed = keys.select(*_hashes("key", shards), "listed")
    return hashed.groupBy("shard").applyInPandas(build, "shard long, levels array<binary>"), shards


def _hashes(key: str, shards: int) -> list[Column]:
    h1 = F.xxhash64(key)
    return [F.pmod(h1, F.lit(shards)).alias("shard"), h1.alias("h1"), F.xxhash64(F.col(key), F.lit(7)).alias("h2")]


def look_up(rows: DataFrame, key: str, cascade: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add in_list to rows by their column key, every value of which must be in the cascade's universe.

    Up to broadcast_bytes the cascade is broadcast whole. A larger one is cut
    into runs of shards of about that size; each run is broadcast for a scan of
    its own, whose rows are written before the next run is fetched, and each row
    is looked up in the one scan that has its shard.
    """
    spark = rows.sparkSession
    sizes = cascade.select("shard", F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = max(1, -(-total // broadcast_bytes))
    per_run = -(-shards // runs)
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("in_list", BooleanType())])
    hashed = rows.select(*_hashes(key, shards), *names)
    out = None
    for first in range(0, shards, per_run):
        here = (F.col("shard") >= first) & (F.col("shard") < first + per_run)
        shared = spark.sparkContext.broadcast({r["shard"]: [bytes(x) for x in r["levels"]] for r in cascade.where(here).collect()})

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, h1, h2 = (batch.column(i).to_numpy() for i in range(3))
                found = np.zeros(len(shard), bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    found[at] = is_listed(shared.value.get(s, []), h1[at].astype(U64), h2[at].astype(U64))
                yield pa.record_batch([*(batch.column(i) for i in range(3, batch.num_columns)), pa.array(found)], [*names, "in_list"])

        part = hashed.where(here).mapInArrow(judge, schema)
        if runs > 1:
            part = keep(part, "judged")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Verdict of every row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules are (verdict, host, path). Where none fits, rule is null, and the
    cascade decides: a host among the rows of listed (host) is blocked, others are
    allowed. The cascade's universe is all hosts of pages, so its answers are
    exact; it is the only place where pages meet the list. A null url, or one
    without ://, has an empty host and path; it fits no rule and is allowed unless
    the empty host is listed. Null and repeated hosts of the list, and those no
    page has, add nothing. Other columns are ignored, repeated rows are each
    returned, urls are read whole, and without pages there are no rows.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = listed.select(F.col("host").alias("key"), F.lit(True).alias("listed")).where("key is not null").distinct()
    hosts = urls.select(F.col("host").alias("key")).distinct().join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascade, shards = build_cascade(hosts)
    found = look_up(urls, "host", keep(cascade, "cascade"), shards)
    rule = match_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("in_list"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"))


def hosts_with_labels(pages: DataFrame, labels: list[str]) -> DataFrame:
    """Hosts of pages with one of labels between their dots, as a list for judge_urls."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    return hosts.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels))))


#: Rules of the production query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host labels of the production list.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every url of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, hosts_with_labels(pages, LISTED_LABELS))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT u.page_id, host, path, rule,
  coalesce(verdict, CASE WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""
