"""Recurring keys of a stream, each told once when it reaches the threshold."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ALERT = StructType([StructField("key", StringType()), StructField("first_time", TimestampType()), StructField("reached_time", TimestampType()), StructField("n", LongType())])


class RunCounter(StatefulProcessor):
    """Counts the rows of a run of one key and tells the run when it has threshold rows.

    A run ends when a key is silent for longer than gap; the next row begins
    another, which can be told again. State is a first and last time and a count for each key that
    has been heard within gap of the watermark; a timer removes it afterwards.
    """

    def __init__(self, threshold: int, gap: timedelta):
        self.threshold, self.gap = threshold, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", StructType([StructField("first", TimestampType()), StructField("last", TimestampType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # counts of equal times; a key's times of one batch are put in order. Each call of the state goes to the JVM and back, so there are few
        times = {}
        for x in rows:
            for time, more in zip(x["time"].tolist(), x["n"].tolist(), strict=True):
                times[time] = times.get(time, 0) + more
        known = self.run.get()
        first, last, n = (pd.Timestamp(known[0]), pd.Timestamp(known[1]), known[2]) if known else (None, None, 0)
        timer = None if last is None else self._timer(last)
        told = []
        for time, more in sorted(times.items()):
            if last is None or time - last > self.gap:
                first, n = time, 0
            # a row that comes late belongs to the run that is open
            last = time if last is None else max(last, time)
            first = min(first, time)
            if n < self.threshold <= n + more:
                told.append((key[0], first, time, self.threshold))
            n += more
        self.run.update((first, last, int(n)))
        if timer != self._timer(last):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._timer(last))
        if told:
            yield pd.DataFrame(told, columns=["key", "first_time", "reached_time", "n"])

    def _timer(self, last: pd.Timestamp) -> int:
        """When a run is over that was last heard then: the one timer of its key."""
        return int((last + self.gap).timestamp() * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def recurrence_alerts(source: DataFrame, key: str, time: str, threshold: int = 3, gap: timedelta = timedelta(days=1), late: str = "0 seconds") -> DataFrame:
    """(key, first_time, reached_time, n): a row for each run of a key, when its threshold-th row comes.

    source is a stream; its rows may be up to late behind. Rows with a null key or time are passed over.
    """
    rows = source.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.lit(1).cast("long").alias("n"))
    rows = rows.withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(RunCounter(threshold, gap), ALERT, outputMode="Append", timeMode="EventTime")


def write_alerts(source: DataFrame, table: str, checkpoint: str, **kinds) -> StreamingQuery:
    """Append recurrence_alerts of all that a stream has now to a Parquet table; a restart goes on where the last run ended, and no alert is written twice."""
    spark: SparkSession = source.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return recurrence_alerts(source, **kinds).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
