"""Weekly user profile and the ledger of its hourly jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.calendar import event_date, hour_calendar, week_u
from emberline.operators.filters import in_zones, slice_
from emberline.operators.reconcile import pct
from emberline.schema import LEDGER, PARTS
from emberline.settings import Settings
from emberline.sources import folders
from emberline.sources.cold import write_partitions


def profile_hours(df: DataFrame, zones) -> DataFrame:
    """Impressions and clicks per user, zone and hour, of those that have any.

    The cold fill table lacks rows without an outcome; leaving groups of nothing out
    makes an increment from it the same as one from the hot rows.
    """
    return (
        in_zones(df, zones)
        .groupBy(*PARTS, "user_id", "zone")
        .agg(
            F.count_if(F.col("has_impression") == 1).alias("impressions"),
            F.count_if(F.col("has_click") == 1).alias("clicks"),
        )
        .where("impressions + clicks > 0")
    )


def profile_hour(df: DataFrame, y: int, m: int, d: int, h: int, zones) -> DataFrame:
    """The increment of one hour."""
    return profile_hours(slice_(df, y, m, d, h), zones).drop(*PARTS)


def profile_week(increments: DataFrame) -> DataFrame:
    """Hourly increments folded into weeks, keyed by year and week."""
    day = event_date()
    folded = increments.groupBy(
        F.col("event_year").alias("profile_year"),
        week_u(day).alias("week_number"),
        "user_id",
        "zone",
    ).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return folded.withColumn("ctr", F.try_divide("clicks", "impressions"))


def save_week(weeks: DataFrame, path: str) -> None:
    """Replace the stored profile of the weeks a frame holds, and of no others."""
    write_partitions(weeks, path, ["profile_year", "week_number"], "parquet")


def profile_backfill(
    cold: DataFrame, y: int, m: int, d: int, h: int, zones, as_of: dt.date | None = None, cfg: Settings = Settings()
) -> DataFrame:
    """The increment of one hour, from the cold fill rows.

    A day that compaction has cut down to clicks has no impressions left: with `as_of`,
    such a day is refused.
    """
    if as_of is not None and (as_of - dt.date(y, m, d)).days >= cfg.cold_days:
        raise ValueError(f"{y}-{m:02d}-{d:02d} holds clicks only, its impressions are gone")
    return profile_hour(cold.where(F.col("event_class") == "fill"), y, m, d, h, zones)


def save_increment(increment: DataFrame, path: str, y: int, m: int, d: int, h: int) -> None:
    """Replace the stored increment of one hour, so a rerun adds nothing twice.

    The hour's folder is written directly: an increment that became empty replaces
    an older one too.
    """
    folder = "/".join(f"{name}={value}" for name, value in zip(PARTS, (y, m, d, h)))
    increment.write.mode("overwrite").parquet(f"{path}/{folder}")


COUNTS = ["impressions", "clicks"]
INCREMENT = "user_id bigint, zone string, impressions bigint, clicks bigint, version int, event_year int, event_month int, event_day int, event_hour int"
WEEK = "user_id bigint, zone string, impressions bigint, clicks bigint, profile_year int, week_number int, version int"


def hour_dir(at: dt.datetime) -> str:
    return "/".join(f"{name}={value}" for name, value in zip(PARTS, (at.year, at.month, at.day, at.hour)))


def _latest(spark: SparkSession, root: str, hours: list[dt.datetime], before: int) -> list[str]:
    """Folders of the last increments of some hours that are older than a version."""
    wanted, found = set(map(hour_dir, hours)), {}
    for day in {at.date() for at in hours}:
        levels = f"event_year={day.year}", f"event_month={day.month}", f"event_day={day.day}"
        for path in folders.partition_dirs(spark, root, ["version", *levels, "event_hour"]):
            version, hour = path.split("/", 1)
            number = int(version.split("=")[1])
            if hour in wanted and number < before:
                found[hour] = max(found.get(hour, 0), number)
    return [f"version={number}/{hour}" for hour, number in found.items()]


def apply_hours(increments: DataFrame, hours: list[dt.datetime], version: int, root: str) -> None:
    """Bring the weekly profile up to date with new increments of some hours, as one version.

    `increments` has the partition columns and stands for all of `hours`. What the profile
    changes by is new counts minus those the hours had before, so a rerun corrects its hours
    and reads no others. Versions grow by run; a run cut short is run again under its own
    number, finds the same older increments, and writes the same changes.
    """
    spark, kept, changed = increments.sparkSession, f"{root}/increments", f"{root}/changes"
    columns = [*PARTS, "user_id", "zone", *COUNTS]
    old = folders.read_listed(spark, kept, INCREMENT, _latest(spark, kept, hours, version))
    taken = [F.expr(f"-{name} AS {name}") for name in COUNTS]
    both = increments.select(*columns).unionByName(old.select(*[c for c in columns if c not in COUNTS], *taken))
    change = profile_week(both).drop("ctr").where("impressions <> 0 OR clicks <> 0")
    plain = change.withColumn("version", F.lit(version))
    folders.delete(spark, f"{changed}/version={version}")
    write_partitions(plain, changed, ["version", "profile_year", "week_number"], "parquet")
    folders.delete(spark, f"{kept}/version={version}")
    write_partitions(increments.select(*columns).withColumn("version", F.lit(version)), kept, ["version", *PARTS], "parquet")
    # Also an hour without rows has this version.
    held = set(folders.partition_dirs(spark, f"{kept}/version={version}", PARTS))
    for path in {hour_dir(at) for at in hours} - held:
        folders.put_text(spark, f"{kept}/version={version}/{path}/_taken", "")


def read_weeks(spark: SparkSession, root: str, weeks: list[tuple[int, int]] | None = None) -> DataFrame:
    """The profile of all weeks, or of some, from its last fold and the changes since."""
    rows = _folded_and_changes(spark, root, weeks)
    total = rows.groupBy("profile_year", "week_number", "user_id", "zone").agg(*[F.sum(name).alias(name) for name in COUNTS])
    return total.where("impressions <> 0 OR clicks <> 0").withColumn("ctr", F.try_divide("clicks", "impressions"))


def _folded_and_changes(spark: SparkSession, root: str, weeks: list[tuple[int, int]] | None) -> DataFrame:
    levels = ["version", "profile_year", "week_number"]
    found: dict[str, dict[str, list[int]]] = {"folds": {}, "changes": {}}
    for table, held in found.items():
        for path in folders.partition_dirs(spark, f"{root}/{table}", levels):
            version, week = path.split("/", 1)
            if weeks is None or tuple(int(x.split("=")[1]) for x in week.split("/")) in weeks:
                held.setdefault(week, []).append(int(version.split("=")[1]))
    last = {week: max(versions) for week, versions in found["folds"].items()}
    since = [f"version={v}/{week}" for week, versions in found["changes"].items() for v in versions if v > last.get(week, -1)]
    folds = folders.read_listed(spark, f"{root}/folds", WEEK, [f"version={v}/{week}" for week, v in last.items()])
    return folds.unionByName(folders.read_listed(spark, f"{root}/changes", WEEK, since))


def fold_weeks(spark: SparkSession, root: str, version: int) -> None:
    """Add up all changes up to a version, the last applied one, and delete what that covers.

    Readers take a week's last fold and later changes only, so a fold may be cut short
    after its write.
    """
    weeks = read_weeks(spark, root).drop("ctr").withColumn("version", F.lit(version))
    write_partitions(weeks, f"{root}/folds", ["version", "profile_year", "week_number"], "parquet")
    for table, limit in (("changes", version), ("folds", version - 1)):
        gone = [name for name in folders.children(spark, f"{root}/{table}") if int(name.split("=")[1]) <= limit]
        for name in gone:
            folders.delete(spark, f"{root}/{table}/{name}")


def change_gate(expected: DataFrame, written: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Expected and written row counts per hour; passed when within the tolerance."""
    keys = ["event_date", "event_hour"]

    def hourly(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(event_date().alias("event_date"), "event_hour").agg(
            F.count("*").alias(name)
        )

    both = hourly(expected, "e").join(hourly(written, "w"), keys, "full_outer")
    both = both.select(
        *keys,
        F.coalesce("e", F.lit(0)).alias("expected"),
        F.coalesce("w", F.lit(0)).alias("written"),
    )
    both = both.withColumn("pct_diff", pct(F.col("written"), F.col("expected")))
    return both.withColumn("passed", F.abs("pct_diff") <= tolerance)


def ledger_rows(hours: DataFrame, job: str, hour_col: str = "hour_ts") -> DataFrame:
    """An open ledger row for each hour: not processed, first try."""
    at = F.col(hour_col)
    after = at + F.expr("INTERVAL 1 HOUR")

    def fields(ts: Column) -> list[Column]:
        return [F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts)]

    values = [
        F.lit(job),
        *fields(at),
        *fields(after),
        week_u(at.cast("date")),
        F.lit(0),
        F.lit(1),
    ]
    return hours.select(*[value.alias(name) for value, name in zip(values, LEDGER)])


def append_ledger(rows: DataFrame, path: str) -> None:
    """Add rows to the ledger table, one folder per job and date."""
    rows.write.mode("append").partitionBy(
        "job_name", "current_year", "current_month", "current_day"
    ).parquet(path)


def close_hours(hours: DataFrame, job: str, done: bool, tries: int, hour_col: str = "hour_ts") -> DataFrame:
    """Ledger rows for the end of a try: processed, or one more try used up.

    Rows are only ever added; readers take the largest of both numbers per hour.
    """
    opened = ledger_rows(hours, job, hour_col)
    return opened.withColumns({"is_processed": F.lit(int(done)), "retries": F.lit(tries if done else tries + 1)})


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*LEDGER)


def ledger_hours(ledger: DataFrame, job: str) -> DataFrame:
    """Ledger rows of a job with the date and hour they stand for."""
    return ledger.where(F.col("job_name") == job).select(
        F.make_date("current_year", "current_month", "current_day").alias("event_date"),
        F.col("current_hour").alias("event_hour"),
        "is_processed",
        "retries",
    )


def unprocessed(ledger: DataFrame, job: str, lo: dt.date, hi: dt.date, max_retries: int = 10) -> DataFrame:
    """Hours of a job still open under the retry cap, and hours never recorded (0 tries)."""
    keys = ["event_date", "event_hour"]
    done = ledger_hours(ledger, job).groupBy(*keys).agg(
        F.max("is_processed").alias("is_processed"), F.max("retries").alias("retries")
    )
    known = hour_calendar(ledger.sparkSession, lo, hi).join(done, keys, "left")
    never = F.col("is_processed").isNull()
    open_ = (F.col("is_processed") == 0) & (F.col("retries") < max_retries)
    return known.where(never | open_).select(
        *keys, F.coalesce("retries", F.lit(0)).alias("retries")
    )


def reprocess_plan(ledger: DataFrame, job: str, gate: DataFrame, max_retries: int = 10) -> DataFrame:
    """Hours of a job to run again and the number of that try.

    An hour is due when it is open in the ledger, when it has data but was never
    recorded, or when its counts failed the gate.
    """
    keys = ["event_date", "event_hour"]
    held = ledger_hours(ledger, job).groupBy(*keys).agg(
        F.max("is_processed").alias("is_processed"), F.max("retries").alias("retries")
    )
    both = held.join(gate.select(*keys, "passed"), keys, "full_outer")
    reason = (
        F.when(F.col("is_processed").isNull(), "never_recorded")
        .when(F.col("is_processed") == 0, "unprocessed")
        .when(~F.col("passed"), "count_mismatch")
    )
    tries = F.coalesce("retries", F.lit(0))
    return both.where(reason.isNotNull() & (tries < max_retries)).select(
        *keys, (tries + 1).alias("retries"), reason.alias("reason")
    )
