"""The interaction table: events as they come, in day folders.

Batches append parts; days that take no more events move to a table of closed days. An
event is known by its id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.columns import with_partitions
from emberline.schema import DAY_PARTS, INTERACTION, PARTS
from emberline.sources import folders
from emberline.sources.cold import write_partitions


def interaction_rows(events: DataFrame) -> DataFrame:
    return with_partitions(events, "ts").select(*INTERACTION.fieldNames())


def append_part(batch: DataFrame, batch_id: int, target: str, writer: str, few: bool = False) -> None:
    """Write a batch as part `<writer>-<batch_id>`; a replay replaces it. `few` says that one task has all its rows."""
    rows = interaction_rows(batch)
    (
        (rows if few else rows.hint("rebalance", *DAY_PARTS))
        .write.mode("overwrite")
        .partitionBy(*DAY_PARTS)
        .parquet(f"{target}/part={writer}-{batch_id:010d}")
    )


def closed_dir(target: str) -> str:
    """The table of closed days beside a table of parts."""
    return f"{target.rstrip('/')}_closed"


def _date(day: str) -> dt.date:
    return dt.date(*[int(level.split("=")[1]) for level in day.split("/")])


def _day_number():
    return (F.col("event_year") * 100 + F.col("event_month")) * 100 + F.col("event_day")


def _listed(spark: SparkSession, target: str) -> tuple[list[str], list[str]]:
    """Folders of open parts, and of closed days. Parts are listed first: a day that closes meanwhile is then in both."""
    parts = folders.partition_dirs(spark, target, ["part", *DAY_PARTS])
    return parts, folders.partition_dirs(spark, closed_dir(target), DAY_PARTS)


def _joined(spark: SparkSession, target: str, parts: list[str], closed: list[str]) -> DataFrame:
    """Rows of parts and closed days. Of a day in both each event counts once."""
    names = INTERACTION.fieldNames()
    open_, done = (folders.read_listed(spark, root, INTERACTION, paths).select(*names) for root, paths in ((target, parts), (closed_dir(target), closed)))
    both = {path.split("/", 1)[1] for path in parts} & set(closed)
    if not both:
        return open_.unionByName(done)
    twice = _day_number().isin([int(_date(day).strftime("%Y%m%d")) for day in both])
    once = open_.where(twice).unionByName(done.where(twice)).dropDuplicates(["event_id"])
    return open_.where(~twice).unionByName(done.where(~twice)).unionByName(once)


def read_interactions(spark: SparkSession, target: str) -> DataFrame:
    """All interactions, each listed folder read once."""
    return _joined(spark, target, *_listed(spark, target)).select("event_id", "user_id", "event_type", *PARTS)


def fold_days(spark: SparkSession, target: str, before: dt.date) -> list[str]:
    """Move the days before a date from the parts into the table of closed days; return them.

    Take a date that no stream accepts events of any more. A day is overwritten by one Spark
    write with what it held and what the listed parts hold, each event once; then the
    parts' folders go. Cut short in between, or when a batch that was folded runs again,
    the day is in both tables, readers count its events once, and the next fold ends it.
    """
    parts, closed = _listed(spark, target)
    due = [path for path in parts if _date(path.split("/", 1)[1]) < before]
    if not due:
        return []
    days = {path.split("/", 1)[1] for path in due}
    rows = _joined(spark, target, due, [day for day in closed if day in days]).dropDuplicates(["event_id"])
    write_partitions(rows, closed_dir(target), DAY_PARTS, "parquet")
    for path in due:
        folders.delete(spark, f"{target}/{path}")
    for part in {path.split("/", 1)[0] for path in due}:
        folders.delete_if_spent(spark, f"{target}/{part}")
    return sorted(days)
