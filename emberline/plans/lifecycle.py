"""Partition lifecycle: what to create, sink, drop, compact and delete, and doing it.

Plans are DataFrames. Functions that change files say so in their first line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.calendar import day_calendar, days_between, event_date
from emberline.operators.filters import slice_
from emberline.operators.lookups import small_side
from emberline.operators.reconcile import CLASSES, gate, pct_diff, reconcile
from emberline.settings import Settings
from emberline.sources import folders
from emberline.sources.cold import replace_days, table_dir

BOUNDS = ["lower_date", "lower_hour", "upper_date", "upper_hour"]


def ranges_of(dates: DataFrame, step_hours: int, date_col: str = "event_date") -> DataFrame:
    """Half-open ranges that tile each date: lower <= x < upper."""
    lower = F.explode(F.sequence(F.lit(0), F.lit(24 - step_hours), F.lit(step_hours)))
    tiled = dates.withColumn("lower_date", F.col(date_col)).withColumn("lower_hour", lower)
    end = F.col("lower_hour") + step_hours
    kept = [name for name in dates.columns if name != date_col]
    return tiled.select(
        *kept,
        "lower_date",
        "lower_hour",
        F.date_add("lower_date", F.floor(end / 24).cast("int")).alias("upper_date"),
        (end % 24).cast("int").alias("upper_hour"),
    )


def range_plan(as_of: DataFrame, ahead: int = 2, step_hours: int = 12) -> DataFrame:
    """Ranges to create for the date `ahead` days after each `as_of`."""
    target = as_of.select(F.date_add("as_of", ahead).alias("event_date"))
    return ranges_of(target, step_hours)


def assign_range(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with the range that covers it; `covered` is false when none does.

    A range is spread over its hours, so a row meets it by equality on date and hour
    instead of by a range comparison. The spread table has at most 24 rows per date.
    """
    def stamp(day: str, hour: str):
        return F.timestamp_add("HOUR", F.col(hour), F.col(day).cast("timestamp_ntz"))

    hours = F.sequence(
        stamp("lower_date", "lower_hour"),
        stamp("upper_date", "upper_hour") - F.expr("INTERVAL 1 HOUR"),
        F.expr("INTERVAL 1 HOUR"),
    )
    spread = ranges.select("lower_date", "lower_hour", F.explode(hours).alias("at")).select(
        "lower_date",
        "lower_hour",
        F.col("at").cast("date").alias("_date"),
        F.hour("at").alias("_hour"),
    )
    met = (event_date() == F.col("_date")) & (F.col("event_hour") == F.col("_hour"))
    return df.join(small_side(spread, Settings().broadcast_bytes), met, "left").select(
        *df.columns, "lower_date", "lower_hour", F.col("lower_date").isNotNull().alias("covered")
    )


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _binned(intervals: DataFrame, width: int) -> DataFrame:
    """Intervals once under each bin they touch. One that is empty or lacks a bound has none."""
    touched = F.sequence(F.floor(_micros("lo") / width), F.floor((_micros("hi") - 1) / width))
    return intervals.where("lo < hi").withColumn("_bin", F.explode(touched))


def assign_interval(df: DataFrame, intervals: DataFrame, ts: str = "request_ts", bin_minutes: int = 360) -> DataFrame:
    """Each row once with every interval `lo` <= time < `hi` that holds it; `covered` is false when none does.

    Intervals have any bounds, and may overlap. Time is cut into bins; an interval is listed
    under each bin it touches, a row looks up its own bin, and the bounds are tested on what
    meets there: a join by equality. Choose bins about as long as the usual interval.
    """
    width = bin_minutes * 60_000_000
    clash = set(df.columns) & {*intervals.columns, "covered"}
    if clash:
        raise ValueError(f"rows and intervals share the columns {sorted(clash)}")
    listed = small_side(_binned(intervals, width).withColumnRenamed("_bin", "_listed"), Settings().broadcast_bytes)
    rows = df.withColumn("_bin", F.floor(_micros(ts) / width))
    held = (F.col("_bin") == F.col("_listed")) & (F.col("lo") <= F.col(ts)) & (F.col(ts) < F.col("hi"))
    return rows.join(listed, held, "left").select(*df.columns, *intervals.columns, F.col("lo").isNotNull().alias("covered"))


def interval_overlaps(intervals: DataFrame, key: str, bin_minutes: int = 360) -> DataFrame:
    """Pairs of intervals that share time, and the part they share: `first` and `second` key, `lo`, `hi`.

    A pair is found in the bin in which its shared part begins, and so once.
    """
    width = bin_minutes * 60_000_000
    names = [F.col(key), F.col("lo"), F.col("hi"), F.col("_bin")]
    left, right = (_binned(intervals, width).select(*[c.alias(f"{mark}_{n}") for c, n in zip(names, ("key", "lo", "hi", "bin"))]) for mark in "ab")
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    begins = F.floor(F.unix_micros(lo.cast("timestamp")) / width)
    met = left.join(right, (F.col("a_bin") == F.col("b_bin")) & (F.col("a_key") < F.col("b_key")) & (lo < hi) & (begins == F.col("a_bin")))
    return met.select(F.col("a_key").alias("first"), F.col("b_key").alias("second"), lo.alias("lo"), hi.alias("hi"))


def drop_plan(
    hot: DataFrame,
    cold: DataFrame,
    as_of: dt.date,
    cfg: Settings = Settings(),
    dates: DataFrame | None = None,
    diffs: DataFrame | None = None,
) -> DataFrame:
    """Hot half-day ranges of D-7: `drop` when the counts agree, else `hold` and why.

    `dates` plans other dates instead, as after an outage. A date passes without a
    comparison only when the hot tier has no row of any class. `residue` counts hot rows
    that are in neither class and so exist nowhere else; they are reported, and hold a
    date that has nothing but them. `verdict` takes counts that were compared before.
    """
    if dates is None:
        due = as_of - dt.timedelta(days=cfg.hot_days)
        dates = day_calendar(hot.sparkSession, due, due)
        hot, cold = (slice_(t, due.year, due.month, due.day) for t in (hot, cold))
    diffs = pct_diff(reconcile(hot, cold)) if diffs is None else diffs
    held = hot.groupBy(event_date().alias("event_date")).agg(
        F.count("*").alias("hot_rows"), F.count_if(~F.col("event_class").isin(*CLASSES)).alias("residue")
    )
    # One row per calendar date each.
    verdict = small_side(gate(diffs, cfg.tolerance_pct), cfg.broadcast_bytes)
    off = small_side(disagreement(diffs, cfg.tolerance_pct), cfg.broadcast_bytes)
    held = small_side(held, cfg.broadcast_bytes)
    checked = dates.join(verdict, "event_date", "left").join(off, "event_date", "left").join(held, "event_date", "left")
    residue = F.coalesce("residue", F.lit(0))
    passed = F.coalesce("passed", F.coalesce("hot_rows", F.lit(0)) == 0)
    alone = F.format_string("%d rows of no class are in the hot tier only", residue)
    planned = checked.select(
        "event_date",
        F.when(passed, "drop").otherwise("hold").alias("action"),
        F.when(~passed, F.coalesce("off", alone)).alias("reason"),
        residue.alias("residue"),
    )
    return ranges_of(planned, 12).select(*BOUNDS, "action", "reason", "residue")


def disagreement(diffs: DataFrame, tolerance: float) -> DataFrame:
    """Per date, which classes differ too much and by how much, in whole percent."""
    hot, cold = F.col("hot_rows"), F.col("cold_rows")
    text = F.format_string(
        "%s: %d hot rows, %d cold, off by %d percent",
        "event_class",
        hot,
        cold,
        F.floor(F.abs("pct_diff")).cast("bigint"),
    )
    wide = diffs.where(F.abs("pct_diff") >= tolerance)
    return wide.groupBy("event_date").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("off"))


def range_text(lower_date, lower_hour, upper_date, upper_hour):
    """A range as `date hour:00 to date hour:00`, the end not included."""
    def bound(day, hour) -> list:
        return [F.col(day).cast("string"), F.col(hour)]

    return F.format_string("%s %02d:00 to %s %02d:00", *bound(lower_date, lower_hour), *bound(upper_date, upper_hour))


def save_residue(rows: DataFrame, dates: list[dt.date], path: str) -> None:
    """Copy the classified hot rows of no class on these dates, so that they outlive the hot tier."""
    lost = rows.where(event_date().isin(*dates) & ~F.col("event_class").isin(*CLASSES)).drop("event_class")
    replace_days(lost.drop("event_date"), path, "parquet", dates)


def apply_drop(spark: SparkSession, plan: DataFrame, hot_dir: str, rows: DataFrame | None = None, residue_dir: str | None = None) -> list[str]:
    """Delete the folders of every range planned as `drop`; return them.

    Rows of no class exist nowhere else: of `rows` (classified) those of the dates that have
    some are copied to `residue_dir` first, and without a place for them such a range stays.
    The table is made of parts with half-day folders, or plain with hour folders. Two
    rows per date reach the driver.
    """
    due = plan.where(F.col("action") == "drop").collect()
    lost = sorted({row.lower_date for row in due if row.residue})
    if lost and rows is not None and residue_dir is not None:
        save_residue(rows, lost, residue_dir)
    elif lost:
        due = [row for row in due if not row.residue]
    parts = [name for name in folders.children(spark, hot_dir) if name.startswith("part=")]
    gone = []
    for row in due:
        day = folders.day_dir(row.lower_date).split("/")
        levels = ["part", *day, "lower_hour"] if parts else [*day, "event_hour"]
        for found in folders.partition_dirs(spark, hot_dir, levels):
            starts = int(found.rsplit("=", 1)[1])
            if row.lower_hour <= starts < (row.upper_hour or 24):
                folders.delete(spark, f"{hot_dir}/{found}")
                gone.append(found)
    for part in parts:
        folders.delete_if_spent(spark, f"{hot_dir}/{part}")
    return gone


def discover(spark: SparkSession, table: str) -> DataFrame:
    """Sync a table's catalog with its folders; list partitions and what changed."""
    before = spark.sql(f"SHOW PARTITIONS {table}")
    before = spark.createDataFrame(before.collect(), before.schema)
    spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
    spark.sql(f"REFRESH TABLE {table}")
    after = spark.sql(f"SHOW PARTITIONS {table}")
    old, new = before.withColumn("_old", F.lit(1)), after.withColumn("_new", F.lit(1))
    return old.join(new, "partition", "full_outer").select(
        "partition",
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .otherwise("present")
        .alias("status"),
    )


def compact_clicks(cold: DataFrame, date: dt.date, fill_dir: str, fmt: str = "orc") -> None:
    """Rewrite one date of the fill table with its clicked rows only.

    Hours without a click go. Spark stages the rows before it replaces those they are
    read from.
    """
    rows = slice_(cold, date.year, date.month, date.day).where(F.col("has_click") == 1)
    replace_days(rows, fill_dir, fmt, [date])


def nofill_survivors(nofill: DataFrame, as_of: dt.date, days: int = 15) -> DataFrame:
    """Nofill rows that outlive retention."""
    return nofill.where(event_date() > F.lit(as_of - dt.timedelta(days=days)))


def nofill_plan(nofill: DataFrame, as_of: dt.date, days: int = 15) -> DataFrame:
    """Folders to delete: expired days, and months that have nothing younger."""
    limit = F.lit(as_of - dt.timedelta(days=days))
    held = nofill.groupBy("event_year", "event_month", "event_day").agg(F.count("*").alias("rows"))
    expired = held.where(event_date() <= limit)
    month_end = F.last_day(F.make_date("event_year", "event_month", F.lit(1)))
    days_gone = expired.select(
        F.lit("day").alias("level"),
        F.col("event_year").alias("year"),
        F.col("event_month").alias("month"),
        F.col("event_day").alias("day"),
    )
    months_gone = (
        expired.where(month_end <= limit)
        .groupBy("event_year", "event_month")
        .agg(F.count("*").alias("_days"))
        .select(
            F.lit("month").alias("level"),
            F.col("event_year").alias("year"),
            F.col("event_month").alias("month"),
            F.lit(None).cast("int").alias("day"),
        )
    )
    return days_gone.unionByName(months_gone)


def apply_nofill_plan(spark: SparkSession, plan: DataFrame, nofill_dir: str) -> list[str]:
    """Delete the planned folders; one row per expired day reaches the driver."""
    gone = []
    for row in plan.orderBy("level", "year", "month", "day").collect():
        tail = f"event_year={row.year}/event_month={row.month}"
        if row.level == "day":
            tail += f"/event_day={row.day}"
        if folders.delete(spark, f"{nofill_dir}/{tail}"):
            gone.append(tail)
    return gone


def reset_days(spark: SparkSession, root: str, date: dt.date) -> DataFrame:
    """Delete a date's hour folders from both cold tables under `root`."""
    out = None
    for event_class in CLASSES:
        part = reset_day(spark, table_dir(root, event_class), date)
        part = part.select(F.lit(event_class).alias("event_class"), "hour", "status")
        out = part if out is None else out.unionByName(part)
    return out


def reset_day(spark: SparkSession, table_dir: str, date: dt.date) -> DataFrame:
    """Delete the 24 hour folders of a date so that a failed sink can run again."""
    rows = []
    for hour in range(24):
        hit = folders.delete(spark, f"{table_dir}/{folders.day_dir(date)}/event_hour={hour}")
        rows.append((hour, "dropped" if hit else "absent"))
    return spark.createDataFrame(rows, "hour int, status string")


def tier_plan(bounds: DataFrame, as_of: dt.date, cfg: Settings = Settings()) -> DataFrame:
    """Actions due for each date from `lo` to `hi`, at `as_of`."""
    age = F.datediff(F.lit(as_of), "event_date")

    def actions(*names: str):
        return F.array(*[F.lit(name) for name in names])

    due = (
        F.when(age < -cfg.create_ahead, actions("none"))
        .when(age == -cfg.create_ahead, actions("create"))
        .when(age < cfg.hot_days, actions("hot"))
        .when(age == cfg.hot_days, actions("sink", "drop_hot"))
        .when(age < cfg.cold_days, actions("cold"))
        .when(age == cfg.cold_days, actions("compact", "delete_nofill"))
        .otherwise(actions("clicks_only"))
    )
    return days_between(bounds, F.col("lo"), F.col("hi")).select(
        "event_date", age.alias("age_days"), F.explode(due).alias("action")
    )
