"""Written tables that cut a plan's lineage, in the folder the cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-ticketspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the written rows.

    A lost executor then costs the stages after this point only, and a stage
    that is needed twice runs once. clear() deletes the files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Folders that keep() wrote in this process and that are still there, the latest last."""
    return list(_written)


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of written(), once nothing reads them any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in set(paths):
        _written.remove(path)
        path = hadoop(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all that keep() wrote in this process, once the results that read it are stored."""
    drop(spark, written())
