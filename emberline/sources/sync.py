"""Incremental copy of day partitions: only what differs is rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.calendar import event_date
from emberline.sources import folders
from emberline.sources.cold import replace_days, replace_partitions


def row_text(df: DataFrame) -> Column:
    """A row as text that any engine can write: times in microseconds, `~` for NULL."""
    def text(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        value = F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("~"))

    return F.concat_ws("|", *[text(name) for name in sorted(df.columns)])


def content_hash(df: DataFrame) -> Column:
    """Order-free fingerprint of whole rows: 60 bits of each row's MD5, summed exactly."""
    return F.sum(row_number_of(df)).alias("content")


def fingerprint(df: DataFrame, content: bool = True) -> DataFrame:
    """Row count, id sum and content hash of every date."""
    extra = [content_hash(df)] if content else [F.lit(0).cast("decimal(30,0)").alias("content")]
    return df.groupBy(event_date().alias("event_date")).agg(
        F.count("*").alias("rows"), F.sum(F.col("user_id").cast("decimal(20,0)")).alias("id_sum"), *extra
    )


def sync_plan(src: DataFrame, dst: DataFrame, content: bool = True) -> DataFrame:
    """What to do with each date: copy, update, skip, or keep (target only).

    With `content` a changed column is seen too; without it rows are compared by
    count and id sum only.
    """
    s = fingerprint(src, content).alias("s")
    d = fingerprint(dst.select(*src.columns), content).alias("d")
    same = (
        F.col("s.rows").eqNullSafe(F.col("d.rows"))
        & F.col("s.id_sum").eqNullSafe(F.col("d.id_sum"))
        & F.col("s.content").eqNullSafe(F.col("d.content"))
    )
    return s.join(d, "event_date", "full_outer").select(
        "event_date",
        F.col("s.rows").alias("src_rows"),
        F.col("d.rows").alias("dst_rows"),
        F.col("s.id_sum").alias("src_id_sum"),
        F.col("d.id_sum").alias("dst_id_sum"),
        F.when(F.col("s.rows").isNull(), "keep")
        .when(F.col("d.rows").isNull(), "copy")
        .when(same, "skip")
        .otherwise("update")
        .alias("action"),
    )


BUCKETS = 16


def bucket(df: DataFrame, key: str = "unique_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows with `bucket`, which follows from the key alone."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint")
    return df.withColumn("bucket", (number % buckets).cast("int"))


def bucket_prints(df: DataFrame, key: str = "unique_id", buckets: int = BUCKETS) -> DataFrame:
    """Row count, id sum and content hash of every date and key bucket: the leaves of a tree of
    two levels. They add up, so a date's own print is the sum of its buckets'."""
    leaves = bucket(df, key, buckets).withColumn("_content", row_number_of(df))
    return leaves.groupBy(event_date().alias("event_date"), "bucket").agg(
        F.count("*").alias("rows"), F.sum(F.col("user_id").cast("decimal(20,0)")).alias("id_sum"), F.sum("_content").alias("content")
    )


def row_number_of(df: DataFrame) -> Column:
    """60 bits of a row's MD5."""
    return F.conv(F.substring(F.md5(row_text(df)), 1, 15), 16, 10).cast("decimal(20,0)")


PRINTS = "bucket int, rows bigint, id_sum decimal(30,0), content decimal(30,0), event_date date"


def save_prints(df: DataFrame, dates: list, path: str, key: str = "unique_id", buckets: int = BUCKETS) -> None:
    """Store the prints of some dates, as the sink that wrote them does; other dates are not read."""
    prints = bucket_prints(df.where(event_date().isin(*dates)), key, buckets)
    replace_partitions(prints, path, ["event_date"], "parquet", [[f"event_date={date}"] for date in dates])


def read_prints(spark: SparkSession, path: str) -> DataFrame:
    if not folders.children(spark, path):
        return spark.createDataFrame([], PRINTS)
    return spark.read.schema(PRINTS).parquet(path)


def prints_plan(src: DataFrame, dst: DataFrame) -> DataFrame:
    """What to do with each date, from stored prints alone, and which buckets differ.

    Dates are compared first, by the sums of their buckets, then the buckets of those that
    differ. One row per date and differing bucket; a date that is copied, kept or skipped
    has one row without a bucket.
    """
    names = ["rows", "id_sum", "content"]

    def root(prints: DataFrame, mark: str) -> DataFrame:
        return prints.groupBy("event_date").agg(*[F.sum(n).alias(f"{mark}_{n}") for n in names])

    both = root(src, "src").join(root(dst, "dst"), "event_date", "full_outer")
    same = F.lit(True)
    for n in names:
        same &= F.col(f"src_{n}").eqNullSafe(F.col(f"dst_{n}"))
    action = F.when(F.col("src_rows").isNull(), "keep").when(F.col("dst_rows").isNull(), "copy").when(same, "skip").otherwise("update")
    dates = both.select("event_date", action.alias("action"))
    leaf = [F.col(n) for n in names]
    s, d = (t.select("event_date", "bucket", F.struct(*leaf).alias(mark)) for t, mark in ((src, "s"), (dst, "d")))
    differ = s.join(d, ["event_date", "bucket"], "full_outer").where(~F.col("s").eqNullSafe(F.col("d"))).select("event_date", "bucket")
    due = dates.where("action = 'update'").join(differ, "event_date")
    rest = dates.where("action <> 'update'").withColumn("bucket", F.lit(None).cast("int"))
    return due.select("event_date", "bucket", "action").unionByName(rest.select("event_date", "bucket", "action"))


def differing_rows(plan: DataFrame, src: DataFrame, dst: DataFrame, key: str = "unique_id", buckets: int = BUCKETS) -> DataFrame:
    """Keys that are new, gone or changed in the buckets that a plan updates.

    The dates prune the scans of both sides: they reach the driver, one entry per calendar
    date at most.
    """
    due = plan.where("action = 'update'").select("event_date", "bucket")
    dates = [row.event_date for row in due.select("event_date").distinct().collect()]

    def side(df: DataFrame, mark: str) -> DataFrame:
        rows = bucket(df.where(event_date().isin(*dates)), key, buckets).withColumn("_date", event_date())
        met = (F.col("_date") == F.col("event_date")) & (rows["bucket"] == due["bucket"])
        rows = rows.withColumn(mark, row_number_of(df)).drop("event_date")
        return rows.join(F.broadcast(due), met, "left_semi").select(F.col("_date").alias("event_date"), key, mark)

    both = side(src, "s").join(side(dst.select(*src.columns), "d"), ["event_date", key], "full_outer")
    status = F.when(F.col("d").isNull(), "new").when(F.col("s").isNull(), "gone").otherwise("changed")
    return both.where(~F.col("s").eqNullSafe(F.col("d"))).select("event_date", key, status.alias("status"))


def sync_apply(plan: DataFrame, src: DataFrame, dst_dir: str, fmt: str = "orc") -> list:
    """Replace the differing dates and return them.

    The list has at most one entry per calendar date. Source partitions of other
    dates are pruned. Days are replaced whole, so an hour that the source no longer
    has goes too.
    """
    due = [
        row.event_date
        for row in plan.where(F.col("action").isin("copy", "update")).select("event_date").collect()
    ]
    if due:
        replace_days(src.where(event_date().isin(*due)), dst_dir, fmt, due)
    return due
