"""Cold ORC tables, one per class, and copies of hot partitions.

The two cold tables are the `event_class` directories of one root, so a single scan
and a single job fill both.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.columns import partition_last
from emberline.operators.filters import classify, slice_
from emberline.operators.reconcile import CLASSES
from emberline.schema import PARTS
from emberline.sources import folders


def table_dir(root: str, event_class: str) -> str:
    return f"{root}/event_class={event_class}"


def write_partitions(
    df: DataFrame, path: str, columns: list[str], fmt: str, dynamic: bool = True, row_group: int | None = None
) -> None:
    """Overwrite the partitions a frame has rows for, and no others.

    With `dynamic` off the whole path is replaced, and a commit marker is left in it.
    `row_group` is the size in bytes of parquet row groups, the least a task can read.

    The rebalance step groups rows by target directory and lets adaptive execution
    split a large directory over several tasks and join small ones, so files stay
    near the advisory size even when one hour holds most rows.
    """
    writer = (
        df.hint("rebalance", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .partitionBy(*columns)
        .format(fmt)
    )
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.save(path)


def replace_partitions(df: DataFrame, path: str, columns: list[str], fmt: str, scope: list[list[str]]) -> None:
    """Overwrite the partitions a frame has rows for; of those in scope, delete the others.

    `scope` lists levels, `column` or `column=value`, whose folders the frame stands for in
    whole. Spark stages and commits the write; a folder that still has the files it had
    before got no rows and goes. A run cut short in between leaves such folders, and the
    next one deletes them.
    """
    spark = df.sparkSession
    found = sorted({part for levels in scope for part in folders.partition_dirs(spark, path, levels)})
    before = {part: folders.files(spark, f"{path}/{part}") for part in found}
    write_partitions(df, path, columns, fmt)
    folders.delete_partitions(spark, path, [p for p, names in before.items() if folders.files(spark, f"{path}/{p}") == names])


def replace_days(df: DataFrame, path: str, fmt: str, dates: list[dt.date]) -> None:
    """Put the rows of whole days in the place of those stored."""
    days = [[*folders.day_dir(date).split("/"), "event_hour"] for date in dates]
    replace_partitions(partition_last(df), path, PARTS, fmt, days)


def sink_classes(hot: DataFrame, root: str) -> None:
    """Write the fill and nofill rows of a frame, each to its own cold table."""
    rows = classify(hot).where(F.col("event_class").isin(*CLASSES))
    write_partitions(partition_last(rows), root, ["event_class", *PARTS], "orc")


def sink_hour(hot: DataFrame, y: int, m: int, d: int, h: int, root: str) -> None:
    sink_day(hot, dt.date(y, m, d), root, h, h)


def sink_day(hot: DataFrame, date: dt.date, root: str, h0: int = 0, h1: int = 23) -> None:
    """Replace the hours of a date in both cold tables.

    An hour that has no rows of a class any more, as after a late event, loses those it had.
    """
    day = slice_(hot, date.year, date.month, date.day).where(F.col("event_hour").between(h0, h1))
    rows = classify(day).where(F.col("event_class").isin(*CLASSES))
    levels = folders.day_dir(date).split("/")
    scope = [["event_class", *levels, f"event_hour={h}"] for h in range(h0, h1 + 1)]
    replace_partitions(partition_last(rows), root, ["event_class", *PARTS], "orc", scope)


def read_cold(spark: SparkSession, root: str, schema) -> DataFrame:
    """Both cold tables with their class; `schema` is that of the hot rows."""
    columns = schema.fieldNames() if hasattr(schema, "fieldNames") else list(schema)
    full = schema.add("event_class", "string") if "event_class" not in columns else schema
    return partition_last(spark.read.schema(full).orc(root))


def migrate_hour(hot: DataFrame, y: int, m: int, d: int, h: int, dest: str) -> None:
    """Copy one hour to another warehouse; running it again replaces the copy."""
    folder = "/".join(f"{name}={value}" for name, value in zip(PARTS, (y, m, d, h)))
    rows = slice_(hot, y, m, d, h).drop(*PARTS)
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{dest}/{folder}")


def migrate_days(hot: DataFrame, as_of: dt.date, minus_days: int, dest: str) -> None:
    """Copy the day `minus_days` before `as_of`; running it again replaces the copy."""
    date = as_of - dt.timedelta(days=minus_days)
    replace_days(slice_(hot, date.year, date.month, date.day), dest, "parquet", [date])
