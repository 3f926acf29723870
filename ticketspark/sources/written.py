"""Tables written in the middle of a plan, so that what is needed twice is worked out once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-ticketspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; clear() deletes what is there."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for costly work on each row, where fewer partitions hold it. A large input keeps its own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame) -> DataFrame:
    """df read back from the shared folder: a lost executor then costs the stages after this point only."""
    path = new_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def paths() -> list[str]:
    """Folders written in this process that are still there, the latest last."""
    return list(_paths)


def drop(spark: SparkSession, some: Iterable[str]) -> None:
    """Delete folders of paths(), once nothing reads them any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in set(some):
        _paths.remove(path)
        path = hadoop(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all that was written in this process, once the results that read it are stored."""
    drop(spark, paths())
