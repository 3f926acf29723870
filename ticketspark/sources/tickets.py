"""Reading tickets, dictionaries and cleaned tables, and writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import time_from_id, to_datetime
from .keyed_table import newest_rows
from ..functions.pack_zh import FIELD_ALIASES
from ..functions.text import filled, strip

TEXT_FIELDS = ["order_id", "content", "title", "subject", "area"]
#: Encodings whose bytes are tried; the first under which no character is unreadable wins.
ENCODINGS = ["utf-8", "gbk", "gb18030", "iso-8859-1"]
REPORT_ROWS = 20_000


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding): for each file of a path the first of ENCODINGS that reads every line of it; an empty file is in the first.

    Lines are looked at as bytes, in ranges of a file, so a large file is no single value;
    a line break is no part of a sign in any of the encodings.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    bad = lambda e: F.expr("try_validate_utf8(raw) is null") if e == "utf-8" else F.contains(F.decode("raw", e), F.lit("�"))
    flags = lines.groupBy("file").agg(*[F.bool_or(bad(e)).alias(e) for e in ENCODINGS[:-1]])
    first = F.coalesce(*[F.when(~F.col(f"`{e}`"), F.lit(e)) for e in ENCODINGS[:-1]], F.lit(ENCODINGS[-1]))
    return flags.select("file", first.alias("encoding"))


def read_tickets_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """CSV files with a header. Without an encoding each file is read in its own (file_encodings).

    Files of one encoding are read together, by the header of their first; columns that another encoding's files lack are null there. A
    byte-order mark before the first header is dropped. The encodings beyond Java's standard ones need
    spark.sql.legacy.javaCharsets, which is left on where a file has one of them.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')

    def read(files: list[str] | str, encoding: str) -> DataFrame:
        df = reader.option("encoding", encoding).csv(files)
        return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff")) if df.columns else df

    if encoding is not None:
        return read(path, encoding)
    # while files are tried, what an encoding can't read is a sign and no error
    settings = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {k: spark.conf.get(k, "false") for k in settings}
    try:
        for k in settings:
            spark.conf.set(k, "true")
        found = file_encodings(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if any(r.encoding != "utf-8" for r in found):
        spark.conf.set(settings[0], "true")
    kinds = sorted({r.encoding for r in found}, key=ENCODINGS.index)
    if len(kinds) < 2:
        return read(path, kinds[0] if kinds else ENCODINGS[0])
    # as many parts as encodings; the metadata gives names as parts of an address
    parts = [read([unquote(r.file) for r in sorted(found) if r.encoding == e], e) for e in kinds]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def conform(df: DataFrame, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> tuple[DataFrame, dict[str, str | None]]:
    """Standard fields by header: an alias that equals a header, else the first alias that holds or is held by one. Others of df stay out."""
    headers = {c.strip().lower(): c for c in df.columns}
    found: dict[str, str | None] = {}
    for field, names in aliases.items():
        names = [n.lower() for n in names]
        equal = [headers[n] for n in names if n in headers]
        near = [c for n in names for h, c in headers.items() if n in h or h in n]
        found[field] = next(iter([*equal, *near]), None)
    return df.select([F.col(f"`{c}`").alias(field) for field, c in found.items() if c is not None] + [c for c in ("_seq",) if c in df.columns and c not in found.values()]), found


def load_tickets(df: DataFrame, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> DataFrame:
    """Standard tickets of any table with _seq (its row order): blank contents go, the first row of each order_id stays.

    Absent ids become AUTO_{_seq}, other absent texts ''. The time is that of the
    field, else the day in the id, else null.
    """
    out, found = conform(df, aliases)
    absent = {c: F.concat(F.lit("AUTO_"), F.col("_seq")) if c == "order_id" else F.lit("") for c in TEXT_FIELDS if found.get(c) is None}
    out = out.withColumns(absent)
    given = to_datetime(F.col("submit_time")) if found.get("submit_time") else F.lit(None).cast("timestamp")
    texts = {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) for c in TEXT_FIELDS}
    out = out.withColumns({"submit_time": F.coalesce(given, time_from_id(F.col("order_id").cast("string"))), **texts})
    return dedup_keep_first(out.where("length(content) > 0"), ["order_id"]).select(*TEXT_FIELDS, "submit_time", "_seq")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: str = "_seq") -> DataFrame:
    """The first row by order of each key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__n", first).where("__n = 1").drop("__n")


def read_ticket_records(df: DataFrame) -> DataFrame:
    """Records of a table with the headers 序号, 工单编号, 标题, 内容; a bad number is 0."""
    text = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("")
    seq = F.coalesce(F.col("序号").try_cast("int"), F.lit(0)) if "序号" in df.columns else F.lit(0)
    return df.select(seq.alias("source_seq"), F.concat(F.lit("seq-"), seq).alias("source_record_id"), text("工单编号").alias("ticket_no"), text("标题").alias("title"), text("内容").alias("content"))


def slice_rows(df: DataFrame, start: int, end: int, order: str = "_seq") -> DataFrame:
    """Rows start to end (exclusive) by a dense row number from 0."""
    return df.where((F.col(order) >= start) & (F.col(order) < max(start, end)))


def with_batches(df: DataFrame, size: int, order: str = "_seq") -> DataFrame:
    """Add batch, the number of the run of size rows that a row is in."""
    return df.withColumn("batch", F.floor(F.col(order) / size))


def read_parquet_cache(spark: SparkSession, path: str, pull) -> DataFrame:
    """The Parquet table at path; if there is none, pull() is written there first."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        pull().write.parquet(path)
    return spark.read.parquet(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """Results as CSV files with a header, each behind a byte-order mark, by which spreadsheets know UTF-8."""
    marked = results.toDF(*[f"\ufeff{c}" if i == 0 else c for i, c in enumerate(results.columns)])
    marked.write.option("header", True).mode("overwrite").csv(path)


def write_report(results: DataFrame, events: DataFrame, path: str, rows: int = REPORT_ROWS) -> None:
    """Two Parquet tables: the first rows of the results, and the event summary."""
    results.limit(rows).write.mode("overwrite").parquet(f"{path}/tickets")
    events.write.mode("overwrite").parquet(f"{path}/events")


def upsert_cleaned(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("ticket_no", "job_id"), version: str = "version") -> DataFrame:
    """Both tables with the newest row of each key; of equal versions the new one. KeyedTable keeps such a table in files."""
    both = existing.withColumn("__later", F.lit(0)).unionByName(new.withColumn("__later", F.lit(1)), allowMissingColumns=True)
    return newest_rows(both, keys, version, "__later")


def get_cleaned(df: DataFrame, job_id: str, limit: int = 100, offset: int = 0, order: str = "_seq") -> DataFrame:
    """A page of a job's rows in insertion order."""
    return df.where(F.col("job_id") == job_id).orderBy(order).offset(offset).limit(limit)


def get_ticket(df: DataFrame, ticket_no: str, job_id: str) -> DataFrame:
    return df.where((F.col("ticket_no") == ticket_no) & (F.col("job_id") == job_id))


def load_dictionary(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Terms (term) of a text file, one a line; blank lines go, and with comments those that begin with #."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("term")).where("term <> ''")
    return lines.where("term not like '#%'") if comments else lines


def synonym_pairs(rows: DataFrame) -> DataFrame:
    """(raw, standard, rank) of rows (raw, standard, _seq): of equal raw words the last, ordered by length, then place."""
    full = rows.where(filled(F.col("raw")).isNotNull() & filled(F.col("standard")).isNotNull())
    last = full.groupBy(strip(F.col("raw")).alias("raw")).agg(F.max_by("standard", "_seq").alias("standard"), F.min("_seq").alias("_seq"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.length("raw")), "_seq"))
    return last.select("raw", strip(F.col("standard")).alias("standard"), rank.alias("rank"))


def load_area_coords(rows: DataFrame) -> DataFrame:
    """(area, lat, lon) of text rows; rows with a number that can't be read go."""
    return rows.select(strip(F.col("area")).alias("area"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")).where("lat is not null and lon is not null")


def preview(df: DataFrame) -> DataFrame:
    """One row: rows, first and last day, different areas (null if none)."""
    areas = F.count_distinct(filled(F.col("area")))
    day = lambda f: F.date_format(f("submit_time"), "yyyy-MM-dd")
    return df.agg(F.count("*").alias("n_rows"), day(F.min).alias("first_day"), day(F.max).alias("last_day"), F.when(areas > 0, areas).alias("n_areas"))
