"""Counts, and the comparison of tiers before anything is dropped."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.calendar import event_date
from emberline.operators.filters import slice_
from emberline.schema import FLAGS, PARTS

CLASSES = ["fill", "nofill"]


def grain_columns(grain: str) -> list[Column]:
    day = event_date().alias("event_date")
    return {"day": [day], "hour": [day, F.col("event_hour")]}[grain]


def counts(df: DataFrame, grain: str = "day") -> DataFrame:
    """Rows per date (and hour) and class."""
    return df.groupBy(*grain_columns(grain), "event_class").agg(F.count("*").alias("rows"))


def daily_counts(df: DataFrame) -> DataFrame:
    return counts(df, "day")


def hourly_counts(df: DataFrame, date: dt.date) -> DataFrame:
    """Rows of every hour of one date; an hour without rows counts 0."""
    found = (
        slice_(df, date.year, date.month, date.day)
        .groupBy("event_hour")
        .agg(F.count("*").alias("n"))
    )
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("event_hour"))
    return hours.join(found, "event_hour", "left").select(
        "event_hour", F.coalesce("n", F.lit(0)).alias("rows")
    )


def reconcile(hot: DataFrame, cold: DataFrame, grain: str = "day") -> DataFrame:
    """Counts of both tiers side by side; an absent side counts 0.

    Each side is counted before the join, so only calendar-sized rows meet.
    """
    keys = ["event_date", *(["event_hour"] if grain == "hour" else []), "event_class"]
    wanted = F.col("event_class").isin(*CLASSES)
    left = counts(hot.where(wanted), grain).withColumnRenamed("rows", "h")
    right = counts(cold.where(wanted), grain).withColumnRenamed("rows", "c")
    return left.join(right, keys, "full_outer").select(
        *keys,
        F.coalesce("h", F.lit(0)).alias("hot_rows"),
        F.coalesce("c", F.lit(0)).alias("cold_rows"),
    )


def pct(actual: Column, base: Column) -> Column:
    """Signed percent difference. Both 0 is 0; only the base 0 is 100."""
    return (
        F.when(base != 0, (actual - base) * 100 / F.nullif(base, F.lit(0)))
        .when(actual == 0, 0.0)
        .otherwise(100.0)
    )


def pct_diff(compared: DataFrame) -> DataFrame:
    return compared.withColumn("pct_diff", pct(F.col("hot_rows"), F.col("cold_rows")))


def gate(diffs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """A date passes only when every class differs by less than the tolerance."""
    return diffs.groupBy("event_date").agg(
        F.bool_and(F.abs("pct_diff") < tolerance).alias("passed")
    )


def mismatch_alerts(diffs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Hours at or over the tolerance, with the text of the alert."""
    return diffs.where(F.abs("pct_diff") >= tolerance).select(
        "event_date",
        "event_hour",
        "event_class",
        "pct_diff",
        F.format_string(
            "Tier counts of %s differ by 1 percent or more for hour %d of %s",
            F.col("event_class"),
            F.col("event_hour"),
            F.col("event_date").cast("string"),
        ).alias("message"),
    )


def flag_counts(df: DataFrame) -> DataFrame:
    """Per date and hour, how many rows carry each flag."""
    return df.groupBy(*grain_columns("hour")).agg(
        *[F.count_if(F.col(flag) == 1).alias(flag.removeprefix("has_") + "s") for flag in FLAGS]
    )


def flag_rollup(df: DataFrame) -> DataFrame:
    """Clicks and impressions per hour, with a subtotal per date and a total.

    Rows are counted per hour first, so that only the hours' counts are rolled up.
    """
    hours = df.groupBy(*grain_columns("hour")).agg(
        F.count_if(F.col("has_click") == 1).alias("clicks"),
        F.count_if(F.col("has_impression") == 1).alias("impressions"),
    )
    return hours.rollup("event_date", "event_hour").agg(
        F.grouping_id().cast("int").alias("grouping"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"),
    )


def availability(tiers: dict[str, DataFrame]) -> DataFrame:
    """First and last date and row count per tier and class, from the data."""
    out = None
    for tier, df in tiers.items():
        day = event_date()
        one = df.groupBy("event_class").agg(
            F.min(day).alias("first_date"),
            F.max(day).alias("last_date"),
            F.count("*").alias("rows"),
        )
        one = one.select(F.lit(tier).alias("tier"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def inventory(df: DataFrame) -> DataFrame:
    """Rows and first and last request time of every partition that has data."""
    return df.groupBy(*PARTS).agg(
        F.count("*").alias("rows"),
        F.min("request_ts").alias("first_ts"),
        F.max("request_ts").alias("last_ts"),
    )


def digest(actions: DataFrame) -> DataFrame:
    """One report line per status from per-partition outcomes.

    The input has two rows per calendar day, whatever the data volume.
    """
    return actions.groupBy("status").agg(
        F.array_join(F.sort_array(F.collect_list("item")), "<br>").alias("report")
    )
