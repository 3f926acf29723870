"""Date and time expressions. Nothing raises: what can't be read is null or empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pack_zh as zh
from .text import has_chinese, let, strip

#: Formats of submit times, tried in turn.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "yyyy-MM-dd'T'HH:mm:ss"]

# fixed values: patterns of dates in texts, tried in turn: pattern, whether it has a year and a time, confidence; an empty first group stands for the year
DATE_PATTERNS = [
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", True, True, 1.0),
    (r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", True, True, 1.0),
    (r"(\d{4})年(\d{1,2})月(\d{1,2})日", True, False, 0.9),
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", True, False, 0.9),
    (r"()(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", False, True, 0.5),
    (r"()(\d{1,2})月(\d{1,2})日", False, False, 0.4),
]


def to_datetime(c: Column) -> Column:
    """The time in the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(strip(c.cast("string")), F.lit(f)) for f in FORMATS])


def time_from_id(c: Column) -> Column:
    """The day in a leading YYMMDD, all years in 20YY; null if there is no such day."""
    d = F.regexp_extract(c, r"^(\d{6})", 1)
    return F.try_to_timestamp(F.concat(F.lit("20"), d), F.lit("yyyyMMdd"))


def parse_datetime(c: Column) -> Column:
    """struct<iso, raw, confidence> of the first pattern (not place) whose first match is in range; without a year iso is --MM-DD."""
    return let(c, _datetime)


def _datetime(c: Column) -> Column:
    none = F.struct(F.lit("").alias("iso"), F.coalesce(strip(c), F.lit("")).alias("raw"), F.lit(0.0).alias("confidence"))
    return F.coalesce(_first_date(c), none)


def _first_date(c: Column) -> Column:
    """What parse_datetime finds, or null."""

    def found(pattern: str, year: bool, time: bool, confidence: float) -> Column:
        # the groups are the runs of digits of the match, so a pattern is looked for once, and none where it can't be
        def read(raw: Column, digits: Column) -> Column:
            part = lambda i: F.get(digits, i - 1 if year else i - 2)
            two = lambda i: F.lpad(F.coalesce(part(i), F.lit("0")), 2, "0")
            ok = two(2).between("01", "12") & two(3).between("01", "31")
            if time:
                ok &= two(4).between("00", "23") & two(5).between("00", "59") & two(6).between("00", "59")
            day = F.concat(*([part(1), F.lit("-")] if year else [F.lit("--")]), two(2), F.lit("-"), two(3))
            clock = F.concat(F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6)) if time else F.lit(" 00:00:00" if year else "")
            return F.when(ok, F.struct(F.concat(day, clock).alias("iso"), raw.alias("raw"), F.lit(confidence).alias("confidence")))

        match = let(F.regexp_extract(c, pattern, 0), lambda raw: F.when(raw != "", let(F.split(raw, "[^0-9]+"), lambda digits: read(raw, digits))))
        return F.when(F.contains(c, F.lit("月")) if "月" in pattern else c.rlike(r"\d[-/]\d{1,2}[-/]\d"), match)

    return F.coalesce(*[found(*p) for p in DATE_PATTERNS])


def extract_time(c: Column) -> Column:
    """struct<start, end, pattern, confidence>: a range, else one date, else a recurring time."""
    return let(c, _time)


def _time(c: Column) -> Column:
    clock = r"日\s*\d{1,2}:\d{1,2}(?::\d{1,2})?"
    to = r"\s*[至到\-~]\s*"

    def span(day: str, factor: float) -> Column:
        pattern = f"({day}{clock}){to}({day}{clock})"
        both = F.struct(*[parse_datetime(F.regexp_extract(c, pattern, i)).alias(n) for i, n in ((1, "a"), (2, "b"))])

        def of(x: Column) -> Column:
            a, b = x["a"], x["b"]
            sure = F.greatest(a["confidence"], b["confidence"]) * factor
            return F.when((a["iso"] != "") & (b["iso"] != ""), F.struct(a["iso"].alias("start"), b["iso"].alias("end"), F.lit("").alias("pattern"), sure.alias("confidence")))

        return F.when(F.contains(c, F.lit("月")) & c.rlike(pattern), let(both, of))

    single = let(_first_date(c), lambda one: F.when(one.isNotNull(), F.struct(one["iso"].alias("start"), F.lit("").alias("end"), F.lit("").alias("pattern"), one["confidence"].alias("confidence"))))
    word = F.when(has_chinese(c), F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(p)) for w, p in zh.TIME_WORDS]))
    again = F.when(word.isNotNull(), F.struct(F.lit("").alias("start"), F.lit("").alias("end"), word.alias("pattern"), F.lit(0.5).alias("confidence")))
    none = F.struct(F.lit("").alias("start"), F.lit("").alias("end"), F.lit("").alias("pattern"), F.lit(0.0).alias("confidence"))
    return F.coalesce(span(r"\d{4}年\d{1,2}月\d{1,2}", 1.0), span(r"\d{1,2}月\d{1,2}", 0.7), single, again, none)


def scope_last_days(df: DataFrame, days: int, time: str = "submit_time") -> DataFrame:
    """Rows of the last days before the latest time; rows without a time go, unless none has one."""
    last = df.agg(F.max(time).alias("__last"))
    inside = F.col("__last").isNull() | (F.col(time) >= F.col("__last") - F.make_interval(days=F.lit(days)))
    return df.crossJoin(F.broadcast(last)).where(inside).drop("__last")
