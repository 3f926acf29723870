"""A Parquet table of newest rows by key, where a batch rewrites only the hash buckets that it touches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a new table; as many rows at most say which folders a version has.
BUCKETS = 64


def newest_rows(rows: DataFrame, keys: Sequence[str], version: str, later: str | None = None) -> DataFrame:
    """The row of each key with the highest version; of equal ones that with the highest later, then the last by the JSON of its columns."""
    order = [F.desc_nulls_last(version), *([F.desc(later)] if later else []), F.desc(F.to_json(F.struct(*[c for c in rows.columns if c != later])))]
    best = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1")
    return best.drop("__n", later) if later else best.drop("__n")


class KeyedTable:
    """Rows under path/rows/bucket=B/made=M, M being a batch's own number, and for each version N of the table the folders it consists of under path/versions/N.

    A version is there once its folder is renamed into place, so a reader sees all
    of a batch or nothing, and goes on reading its version while a later one is
    written. A writer first makes the file path/claims/N, which only one can; a second writer of
    that version fails, and what it wrote is in no version. If a writer
    is lost between the two, its claim is to be deleted by hand.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str = "version", buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path.rstrip("/"), list(keys), version, buckets
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The latest version; 0 before the first batch."""
        folder = self._file(f"{self.path}/versions")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0) if self._fs.exists(folder) else 0

    def folders(self, number: int | None = None) -> dict[int, int]:
        """Which batch made each bucket of a version."""
        number = self.number() if number is None else number
        return {r.bucket: r.made for r in self.spark.read.schema("bucket int, made long").parquet(f"{self.path}/versions/{number}").collect()} if number else {}

    def read(self, number: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of a version (None before the first), of some buckets alone if they are named."""
        chosen = {b: m for b, m in self.folders(number).items() if only is None or b in set(only)}
        paths = [f"{self.path}/rows/bucket={b}/made={m}" for b, m in sorted(chosen.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def upsert(self, rows: DataFrame) -> int:
        """Take the rows of a batch where their version is not lower than what a key has; the number of the new version.

        Of equal versions the batch's row counts, and within the batch the last by
        the JSON of its columns. Rows with a null key are one key. Columns that only one side has are null on the other.
        """
        before = self.number()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        made = f"{self.path}/batches/{uuid.uuid4().hex}"
        # the batch is worked out once
        rows.withColumn("bucket", bucket).write.parquet(made)
        batch = self.spark.read.parquet(made)
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())
        if touched:
            old = self.read(before, touched)
            new = batch.withColumn("__later", F.lit(1))
            both = new if old is None else new.unionByName(old.withColumns({"__later": F.lit(0), "bucket": bucket}), allowMissingColumns=True)
            number = uuid.uuid4().int >> 65
            staged = f"{self.path}/batches/{number}"
            newest_rows(both, ["bucket", *self.keys], self.version, "__later").repartition("bucket").write.partitionBy("bucket").parquet(staged)
            for b in touched:
                self._move(f"{staged}/bucket={b}", f"{self.path}/rows/bucket={b}/made={number}")
            self._fs.delete(self._file(staged), True)
            listed = f"{self.path}/batches/{uuid.uuid4().hex}"
            folders = sorted((self.folders(before) | dict.fromkeys(touched, number)).items())
            self.spark.createDataFrame(folders, "bucket int, made long").coalesce(1).write.parquet(listed)
            if not self._fs.createNewFile(self._file(f"{self.path}/claims/{before + 1}")):
                raise FileExistsError(f"another writer has made version {before + 1}")
            self._move(listed, f"{self.path}/versions/{before + 1}")
        self._fs.delete(self._file(made), True)
        return self.number()

    def _move(self, source: str, target: str) -> None:
        target = self._file(target)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._file(source), target):
            raise OSError(f"could not move {source} to {target}")

    def drop_old(self) -> None:
        """Delete versions but the latest, and what only they have; readers of those must be done."""
        number, now = self.number(), self.folders()
        for b in range(self.buckets):
            folder = self._file(f"{self.path}/rows/bucket={b}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if int(s.getPath().getName().split("=")[1]) != now.get(b):
                    self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._file(f"{self.path}/versions")):
            if s.getPath().getName() != str(number):
                self._fs.delete(s.getPath(), True)
