"""Incremental cleaning, as a batch and as a stream, and a running recurrence count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.keyed_table import KeyedTable
from ..sources.tickets import upsert_cleaned


def split_by_cache(new: DataFrame, done: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Rows of new that are still to do, and the done rows of the others."""
    keys = new.select(key).distinct()
    return new.join(done.select(key).distinct(), key, "left_anti"), done.join(keys, key, "left_semi")


def clean_into(table: KeyedTable, new: DataFrame, clean: Callable[[DataFrame], DataFrame], key: str = "content_hash") -> int:
    """Clean the rows of new whose key the table lacks, and upsert them: only the buckets they fall into are written again. The table's version."""
    done = table.read()
    return table.upsert(clean(new if done is None else split_by_cache(new, done, key)[0]))


def clean_incremental(new: DataFrame, done: DataFrame, clean: Callable[[DataFrame], DataFrame], key: str = "content_hash") -> DataFrame:
    """done with the cleaned rows of new that it lacks; clean keeps ticket_no, job_id, version and the key."""
    todo, _ = split_by_cache(new, done, key)
    return upsert_cleaned(done, clean(todo))


def clean_stream(source: DataFrame, table: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Clean all files that a streaming source has now into the Parquet table, each input once even after a failure.

    A batch writes its own partition of the table, over what an earlier try left,
    so repeating it changes nothing; readers take the newest row of a key (newest).
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = clean(batch).withColumns({"version": F.lit(number).cast("long"), "batch": F.lit(number).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """A stream of the Parquet files at path, which may be a file or a folder; maxFilesPerTrigger and the like bound a batch."""
    # as a pattern, since the source takes a plain path for a folder
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def newest(table: DataFrame) -> DataFrame:
    """The newest row of each ticket and job of a table that clean_stream wrote."""
    return upsert_cleaned(table, table.limit(0))


def recurrence_stream(source: DataFrame, key: str, threshold: int = 3, late: str = "1 day") -> DataFrame:
    """Running counts of a key by day of submit_time, with a flag from threshold on (no counterpart in a batch product)."""
    days = F.window("submit_time", "1 day")
    counts = source.withWatermark("submit_time", late).groupBy(days, F.col(key)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("day"), key, "n", (F.col("n") >= threshold).alias("recurring"))
