"""Row filters and the fill / nofill classes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.calendar import event_date
from emberline.schema import OUTCOMES


def is_fill() -> Column:
    """Any outcome flag is 1."""
    return F.expr(" OR ".join(f"{flag} = 1" for flag in OUTCOMES))


def is_nofill() -> Column:
    """A request, and every outcome flag is NULL. A 0 is not NULL."""
    return F.expr(" AND ".join(["has_request = 1", *[f"{flag} IS NULL" for flag in OUTCOMES]]))


def slice_(df: DataFrame, y: int, m: int, d: int, h: int | None = None) -> DataFrame:
    """One day, or one hour of it, by equality on the partition columns."""
    cut = df.where(
        (F.col("event_year") == y) & (F.col("event_month") == m) & (F.col("event_day") == d)
    )
    return cut if h is None else cut.where(F.col("event_hour") == h)


def fill(df: DataFrame) -> DataFrame:
    return df.where(is_fill())


def nofill(df: DataFrame) -> DataFrame:
    return df.where(is_nofill())


def classify(df: DataFrame) -> DataFrame:
    """Both classes in one pass; rows of neither are `unclassified`."""
    return df.withColumn(
        "event_class",
        F.when(is_fill(), "fill").when(is_nofill(), "nofill").otherwise("unclassified"),
    )


def unclassified_audit(df: DataFrame) -> DataFrame:
    """Rows that no cold table receives, by date and reason."""
    no_request = F.col("has_request").isNull() | (F.col("has_request") != 1)
    return (
        classify(df)
        .where(F.col("event_class") == "unclassified")
        .groupBy(
            event_date().alias("event_date"),
            F.when(no_request, "no_request").otherwise("zero_flag").alias("reason"),
        )
        .agg(F.count("*").alias("rows"))
    )


def window_(df: DataFrame, lo: dt.date | None = None, hi: dt.date | None = None) -> DataFrame:
    """Dates after `lo` and up to `hi`, over the integer partition columns."""
    day = event_date()
    if lo is not None:
        df = df.where(day > F.lit(lo))
    return df if hi is None else df.where(day <= F.lit(hi))


def clicks(df: DataFrame, lo: dt.date | None = None, hi: dt.date | None = None) -> DataFrame:
    """Clicked rows of a date window. Without `lo` it is the whole history."""
    return window_(df.where(F.col("has_click") == 1), lo, hi)


def in_zones(df: DataFrame, zones) -> DataFrame:
    return df.where(F.col("zone").isin(*zones))


def lateness(day: Column, as_of: dt.date, max_age: int, ahead: int = 2) -> Column:
    """`too_late`, `future`, or NULL when a partition covers the date."""
    return F.when(day < F.lit(as_of - dt.timedelta(days=max_age)), "too_late").when(
        day > F.lit(as_of + dt.timedelta(days=ahead)), "future"
    )


def timely(
    df: DataFrame,
    as_of: dt.date,
    max_age: int,
    ahead: int = 2,
    ts_col: str = "request_ts",
    rejects: bool = False,
) -> DataFrame:
    """Rows whose date a hot partition covers, or the others with their reason."""
    reason = lateness(F.col(ts_col).cast("date"), as_of, max_age, ahead)
    if rejects:
        return df.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return df.where(reason.isNull())
