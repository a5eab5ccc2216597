"""Connected components of links, by alternating star steps over DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources import folders


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder all executors share; lineage ends there.

    The shuffle files behind them go at once, not when the driver next collects its
    garbage: an operator runs several such steps over a large table.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folders.workspace(spark, "steps"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(CLEANUP, before)


class Stored:
    """Rows written as a table to the shared folder, for steps that are deleted once they are used."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, folders.workspace(df.sparkSession, "table")
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        folders.delete(self.spark, self.path)


def _star(links: DataFrame, other: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included, beside its links."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return other.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """`node` and `component` (its smallest reachable node) of all nodes of the links u, v.

    Alternates two steps until links no longer change: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows. Links settle within the
    square of the logarithm of their number. A hub is aggregated before the shuffle and its
    links are an ordinary join, which adaptive execution splits. Links from a node to itself
    are ignored. A round's table is deleted when the next one is written.
    """
    first = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down, before, rounds = Stored(first), None, None
    while True:
        both = down.rows.union(down.rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, large)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = small.select("u", F.col("m").alias("v"))
        new = Stored(kept.union(moved).distinct())
        down.drop()
        down = new
        now = down.rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        rounds = 8 + 2 * math.ceil(math.log2(now[0] + 2)) ** 2 if rounds is None else rounds - 1
        if rounds <= 0:
            raise RuntimeError("links have not settled")
        before = now
    stars = down.rows.groupBy("u").agg(F.min("v").alias("v"))
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
