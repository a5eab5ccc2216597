"""One reading of both tiers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.calendar import event_date
from emberline.functions.columns import partition_last
from emberline.operators.filters import clicks, window_
from emberline.schema import PARTS
from emberline.settings import Settings


def cutoffs(as_of: dt.date, cfg: Settings) -> tuple[dt.date, dt.date]:
    """Dates after the first are hot; dates after the second, up to it, are cold."""
    return as_of - dt.timedelta(days=cfg.hot_days), as_of - dt.timedelta(days=cfg.cold_days)


def tier_view(hot: DataFrame, cold: DataFrame, as_of: dt.date, cfg: Settings = Settings()) -> DataFrame:
    """The rolling window. The two parts share no date, so no row comes twice."""
    hot_from, cold_from = cutoffs(as_of, cfg)
    recent = partition_last(window_(hot, hot_from, as_of))
    older = window_(cold, cold_from, hot_from).select(*recent.columns)
    return recent.unionByName(older)


def clicks_view(hot: DataFrame, cold: DataFrame, as_of: dt.date, cfg: Settings = Settings()) -> DataFrame:
    """Clicks of the whole history: recent ones hot, all earlier ones cold."""
    hot_from, _ = cutoffs(as_of, cfg)
    recent = partition_last(clicks(hot, hot_from, as_of))
    older = clicks(cold, hi=hot_from).select(*recent.columns)
    return recent.unionByName(older)


def view_sql(spark: SparkSession, view: str, t1: str, t2: str, c1: str, c2: str, verb: str = "CREATE OR REPLACE") -> str:
    """Text of a two-table view. Columns come from the first table's schema."""
    names = spark.table(t1).columns
    lacking = set(names) - set(spark.table(t2).columns)
    if lacking:
        raise ValueError(f"{t2} lacks the columns {sorted(lacking)} of {t1}")
    listed = ", ".join(f"`{n}`" for n in [n for n in names if n not in PARTS] + PARTS)
    return (
        f"{verb} VIEW {view} AS "
        f"SELECT {listed} FROM {t1} WHERE {c1} "
        f"UNION ALL SELECT {listed} FROM {t2} WHERE {c2}"
    )


def window_sql(lo: dt.date | None, hi: dt.date | None) -> str:
    """A date window as a predicate on the partition columns, in parentheses."""
    day = "make_date(event_year, event_month, event_day)"
    bounds = []
    if lo is not None:
        bounds.append(f"{day} > DATE '{lo}'")
    if hi is not None:
        bounds.append(f"{day} <= DATE '{hi}'")
    return f"({' AND '.join(bounds) or 'true'})"


def define_view(spark: SparkSession, view: str, t1: str, t2: str, c1: str, c2: str) -> DataFrame:
    """Create the view, or change it when it exists, and return its rows."""
    verb = "ALTER" if spark.catalog.tableExists(view) else "CREATE OR REPLACE"
    spark.sql(view_sql(spark, view, t1, t2, c1, c2, verb))
    return spark.table(view)


def tier_sql(spark: SparkSession, view: str, hot: str, cold: str, as_of: dt.date, cfg: Settings = Settings(), verb: str = "ALTER") -> str:
    """Text that gives a view the bounds of a date."""
    hot_from, cold_from = cutoffs(as_of, cfg)
    return view_sql(spark, view, hot, cold, window_sql(hot_from, as_of), window_sql(cold_from, hot_from), verb)


def stored_text(spark: SparkSession, view: str) -> str | None:
    """The query that the catalog keeps for a view; None without one."""
    if not spark.catalog.tableExists(view):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {view}").where("col_name = 'View Text'").select("data_type").collect()
    return rows[0][0] if rows else None


def _specs(paths: list[str]) -> str:
    """Partition folders `a=x/b=1` as SQL partition specs; values are quoted, Spark casts them."""
    levels = [[level.split("=", 1) for level in path.split("/")] for path in paths]
    return ", ".join("PARTITION (" + ", ".join(f"{name}='{value}'" for name, value in spec) + ")" for spec in levels)


def add_partitions(spark: SparkSession, table: str, paths: list[str]) -> None:
    """Tell the catalog of partition folders; other partitions are not looked at."""
    if paths:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {_specs(paths).replace('), PARTITION', ') PARTITION')}")
        spark.sql(f"REFRESH TABLE {table}")


def drop_partitions(spark: SparkSession, table: str, paths: list[str]) -> None:
    """Make the catalog forget partitions whose folders are gone."""
    if paths:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_specs(paths)}")
        spark.sql(f"REFRESH TABLE {table}")


def switch_view(spark: SparkSession, view: str, hot: str, cold: str, as_of: dt.date, cfg: Settings = Settings()) -> str:
    """Move the view's bounds to a date; return what the catalog then keeps, which must be what was asked for."""
    verb = "ALTER" if spark.catalog.tableExists(view) else "CREATE"
    text = tier_sql(spark, view, hot, cold, as_of, cfg, verb)
    spark.sql(text)
    kept = stored_text(spark, view)
    if kept != text.split(" AS ", 1)[1]:
        raise ValueError(f"the catalog keeps another definition of {view}: {kept}")
    return kept


def overlap_audit(
    hot: DataFrame, cold: DataFrame, lo: dt.date | None = None, hi: dt.date | None = None
) -> DataFrame:
    """Keys held by both tiers, per date.

    The date is part of the comparison, since a key's date never changes. When the
    dates both tiers may hold are known, `lo` and `hi` prune the scans to them.
    """
    hot, cold = window_(hot, lo, hi), window_(cold, lo, hi)
    keys = [event_date().alias("event_date"), F.col("unique_id")]
    both = hot.select(*keys).intersect(cold.select(*keys))
    return both.groupBy("event_date").agg(F.count("*").alias("overlap_keys"))
