"""Calendar expressions. Nothing here reads a clock: the date is always passed in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.schema import PARTS


def event_date() -> Column:
    """The partition tuple as a date. Comparisons on it prune partitions."""
    return F.make_date("event_year", "event_month", "event_day")


def parts_of(ts: Column) -> list[Column]:
    """Year, month, day and hour of a timestamp, named as partition columns."""
    taken = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts)]
    return [value.cast("int").alias(name) for value, name in zip(taken, PARTS)]


def utc_parts(text: Column) -> list[Column]:
    """`YYYY-MM-DDTHH:MM:SSZ` to integers; NULLs when the text is not a time."""
    ts = text.try_cast("timestamp_ntz")
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
    ]


def offsets(
    df: DataFrame, as_of: str, days: list[int] = (), hours: list[int] = ()
) -> DataFrame:
    """One row per input row and offset: label and the parts of the shifted time.

    `as_of` names a TIMESTAMP_NTZ column. Interval arithmetic crosses month, year
    and leap-day borders by itself.
    """
    steps = [("d", n, 24) for n in days] + [("h", n, 1) for n in hours]
    shifted = [
        F.struct(
            F.lit(f"{n:+d}{unit}").alias("label"),
            (F.col(as_of) + F.expr(f"INTERVAL '{n * width}' HOUR")).alias("at"),
        )
        for unit, n, width in steps
    ]
    at = F.col("offset.at")
    return df.withColumn("offset", F.explode(F.array(*shifted))).select(
        *df.columns,
        F.col("offset.label").alias("label"),
        F.year(at).alias("year"),
        F.month(at).alias("month"),
        F.dayofmonth(at).alias("day"),
        F.hour(at).alias("hour"),
    )


def week_u(day: Column) -> Column:
    """Sunday-first week of the year, 0 to 53. This is not the ISO week."""
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("int")


def days_between(df: DataFrame, lo: Column, hi: Column, name: str = "event_date") -> DataFrame:
    """Explode a calendar, both ends included, from bounds held in each row."""
    return df.withColumn(name, F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))))


def day_calendar(spark, lo: dt.date, hi: dt.date) -> DataFrame:
    """One row per date of a closed range."""
    return days_between(spark.range(1), F.lit(lo), F.lit(hi)).select("event_date")


def hour_calendar(spark, lo: dt.date, hi: dt.date) -> DataFrame:
    """One row per date and hour of a closed date range."""
    return with_hours(day_calendar(spark, lo, hi))


def with_hours(days: DataFrame) -> DataFrame:
    """Every row once for each hour of the day."""
    return days.withColumn("event_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
