from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ticketspark.streaming.incremental import clean_incremental, clean_stream, file_stream, newest, recurrence_stream
from ticketspark.streaming.recurrence_alerts import ALERT, write_alerts

SCHEMA = "ticket_no string, job_id string, content string"


def _clean(df):
    return df.select("ticket_no", "job_id", F.upper("content").alias("content"), F.md5("content").alias("content_hash"))


def test_cleaning_twice_adds_nothing(spark):
    new = spark.createDataFrame([("1", "j", "a"), ("2", "j", "b")], SCHEMA).withColumn("content_hash", F.md5("content"))
    done = new.limit(0).withColumn("version", F.lit(1))
    make = lambda df: _clean(df).withColumn("version", F.lit(1))
    once = clean_incremental(new, done, make)
    twice = clean_incremental(new, once, make)
    assert sorted(map(tuple, once.select("ticket_no", "content").collect())) == sorted(map(tuple, twice.select("ticket_no", "content").collect())) == [("1", "A"), ("2", "B")]


def test_stream_resumes(spark, tmp_path):
    source, table, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    for n, rows in enumerate(([("1", "j", "a")], [("2", "j", "b"), ("1", "j", "c")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        clean_stream(spark.readStream.schema(SCHEMA).parquet(source), table, point, _clean).awaitTermination(120)
        assert spark.read.parquet(table).count() == (1, 3)[n]
    assert {(r.ticket_no, r.content) for r in newest(spark.read.parquet(table)).collect()} == {("1", "C"), ("2", "B")}


def test_recurrence_stream(spark, tmp_path):
    rows = [(datetime(2025, 1, 1, h), "k" if h < 3 else "m") for h in range(5)] + [(datetime(2025, 1, 9), "z")]
    spark.createDataFrame(rows, "submit_time timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = recurrence_stream(spark.readStream.schema("submit_time timestamp, k string").parquet(str(tmp_path / "in")), "k")
    stream.writeStream.format("memory").queryName("days").outputMode("update").trigger(availableNow=True).start().awaitTermination(120)
    last = {r.k: (r.n, r.recurring) for r in spark.table("days").collect()}
    assert last["k"] == (3, True) and last["m"] == (2, False)


def _alerts(spark, source, table, point):
    stream = file_stream(spark, source, "k string, t timestamp", maxFilesPerTrigger="1")
    write_alerts(stream, table, point, key="k", time="t", threshold=3, gap=timedelta(hours=2), late="1 hour").awaitTermination(300)
    return sorted(((r.key, r.first_time.hour, r.reached_time.hour) for r in spark.read.schema(ALERT).parquet(table).collect()), key=str)


def test_alerts_are_told_once_over_a_restart(spark, tmp_path):
    source, table, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    at = lambda *rows: spark.createDataFrame([(k, datetime(2025, 1, 1, h, m)) for k, h, m in rows], "k string, t timestamp").coalesce(1).write.mode("append").parquet(source)
    at(("a", 1, 0), ("b", 1, 0), ("a", 2, 0), (None, 1, 0))
    assert _alerts(spark, source, table, point) == []
    # the state is read again after a restart: a's third comes now, and b's second comes too late for one run
    at(("a", 3, 0), ("a", 3, 30), ("b", 6, 0))
    assert _alerts(spark, source, table, point) == [("a", 1, 3)]
    # a is silent for over two hours, so its next run is told again; rows before the watermark change nothing
    at(("a", 9, 0), ("a", 9, 0), ("a", 9, 0), ("a", 10, 0), ("b", 7, 0), ("b", 8, 0))
    assert _alerts(spark, source, table, point) == [("a", 1, 3), ("a", 9, 9), ("b", 6, 8)]
    at(("c", 23, 0))
    assert _alerts(spark, source, table, point) == [("a", 1, 3), ("a", 9, 9), ("b", 6, 8)]


def test_a_key_calls_its_state_few_times():
    import pandas as pd

    from ticketspark.streaming.recurrence_alerts import RunCounter

    calls, kept = [], {}

    class State:
        def get(self):
            calls.append("get")
            return kept.get("run")

        def update(self, value):
            calls.append("update")
            kept["run"] = value

    class Handle:
        def registerTimer(self, at):
            calls.append("register")
            kept["timer"] = at

        def deleteTimer(self, at):
            calls.append("delete")
            assert at == kept["timer"]

    counter = RunCounter(3, timedelta(hours=2))
    counter.run, counter.handle = State(), Handle()
    at = lambda *hours: iter([pd.DataFrame({"time": [pd.Timestamp(2025, 1, 1, h) for h in hours], "n": 1})])
    told = lambda *hours: [tuple(r) for x in counter.handleInputRows(("a",), at(*hours), None) for r in x.itertuples(index=False)]
    assert told(3, 1) == [] and calls == ["get", "update", "register"]
    calls.clear()
    assert told(2) == [("a", pd.Timestamp(2025, 1, 1, 1), pd.Timestamp(2025, 1, 1, 2), 3)] and calls == ["get", "update"]
    assert told(9, 9, 10) == [("a", pd.Timestamp(2025, 1, 1, 9), pd.Timestamp(2025, 1, 1, 10), 3)] and calls[-1] == "register"
