"""The daily chain: sink, view, reconcile, drop."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.filters import classify, slice_
from emberline.operators.reconcile import pct_diff, reconcile
from emberline.plans.lifecycle import apply_drop, drop_plan
from emberline.plans.views import add_partitions, drop_partitions, switch_view, tier_view
from emberline.settings import Settings
from emberline.sources import folders
from emberline.sources.cold import read_cold, sink_day
from emberline.streaming.hot import fold, read_hot
from emberline.streaming.interactions import fold_days


@dataclass(frozen=True)
class CatalogView:
    """The view over both tiers, and the tables in the catalog that it reads."""

    name: str
    hot: str
    cold: str


def daily_chain(
    hot: DataFrame,
    cold_root: str,
    as_of: dt.date,
    cfg: Settings = Settings(),
    sink: Callable[[DataFrame, dt.date, str], None] = sink_day,
    hot_dir: str | None = None,
    view: CatalogView | None = None,
    interactions_dir: str | None = None,
) -> DataFrame:
    """Run the day's stages in order; the first failure skips the rest.

    Rows are: rows sunk, rows of that day the view shows (as many, or the stage fails),
    classes that disagree, ranges to drop. With `hot_dir` these ranges are dropped
    there, and the hot table, if streams wrote it in parts, is folded first; hot rows of
    no class are copied to `<cold_root>_residue` before their range goes. With `view` the
    view in the catalog gets the new bounds once the day is sunk and before it is dropped,
    and the day is read through it; a failed sink leaves its old definition. With
    `interactions_dir` days that take no more interactions are closed. Every stage reads
    the one day only, and the tiers are compared once. Errors of the code itself are raised.
    """
    spark = hot.sparkSession
    date = as_of - dt.timedelta(days=cfg.hot_days)
    if hot_dir is not None and any(name.startswith("part=") for name in folders.children(spark, hot_dir)):
        fold(spark, hot_dir, cfg.fold_after_parts)
        hot = read_hot(spark, hot_dir)

    def cold() -> DataFrame:
        return read_cold(spark, cold_root, hot.schema)

    def day(df: DataFrame) -> DataFrame:
        return slice_(df, date.year, date.month, date.day)

    found: dict = {}

    def run_sink() -> int:
        sink(hot, date, cold_root)
        found["sunk"] = day(cold()).count()
        return found["sunk"]

    def run_view() -> int:
        if view is not None:
            levels = ["event_class", *folders.day_dir(date).split("/"), "event_hour"]
            add_partitions(spark, view.cold, folders.partition_dirs(spark, cold_root, levels))
            switch_view(spark, view.name, view.hot, view.cold, as_of, cfg)
            return day(spark.table(view.name)).count()
        return day(tier_view(hot, cold().drop("event_class"), as_of, cfg)).count()

    def classified() -> DataFrame:
        return classify(day(hot))

    def run_reconcile() -> int:
        diffs = pct_diff(reconcile(classified(), day(cold())))
        # One row per class of the day.
        found["diffs"] = spark.createDataFrame(diffs.collect(), diffs.schema)
        return found["diffs"].where(F.abs("pct_diff") >= cfg.tolerance_pct).count()

    def run_drop() -> int:
        plan = drop_plan(classified(), cold(), as_of, cfg, diffs=found["diffs"])
        plan = spark.createDataFrame(plan.collect(), plan.schema)
        if hot_dir is not None:
            gone = apply_drop(spark, plan, hot_dir, classified(), f"{cold_root}_residue")
            if view is not None:
                drop_partitions(spark, view.hot, gone)
        if interactions_dir is not None:
            fold_days(spark, interactions_dir, as_of - dt.timedelta(days=cfg.interaction_late_days))
        return plan.where(F.col("action") == "drop").count()

    stages: list[tuple[str, Callable[[], int], Callable[[int], bool]]] = [
        ("sink", run_sink, lambda n: True),
        ("view", run_view, lambda n: n == found["sunk"]),
        ("reconcile", run_reconcile, lambda n: n == 0),
        ("drop", run_drop, lambda n: n > 0),
    ]
    report, failed = [], False
    for name, run, ok in stages:
        if failed:
            report.append((name, "skipped", None))
            continue
        try:
            rows = run()
            failed = not ok(rows)
            report.append((name, "failed" if failed else "ok", rows))
        except (TypeError, NameError, AttributeError, LookupError):
            raise
        except Exception as error:  # a failed stage is a row of the report
            failed = True
            said = str(error).strip().split("\n")[0][:200]
            report.append((name, f"failed: {type(error).__name__}: {said}", None))
    return spark.createDataFrame(report, "stage string, status string, rows bigint")
