"""Metrics of streams: what a batch's own write has seen, and what a query reports.

A batch is counted by an observation inside the plan that writes it, so no job runs for
its metrics. Each batch, or each report, is one small file of one JSON row; it is written
through the file system, and a replay replaces it.
"""

from __future__ import annotations

import json
import threading

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from emberline.schema import BATCH, REASONS
from emberline.sources import folders

METRICS_SCHEMA = "query string, batch_id bigint, input_rows bigint"


def observed(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that counts them by reason as they are first used."""
    seen = Observation()
    reason = F.col("reason")
    counts = [F.count_if(reason == name).alias(name) for name in REASONS]
    return judged.observe(
        seen,
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(reason.isNull()).alias("kept_rows"),
        F.count_if(F.col("user_id").isNull()).alias("null_users"),
        F.max(F.col("ts").cast("string")).alias("last_ts"),
        *counts,
    ), seen


def counts_of(seen: Observation) -> dict:
    """What was observed. A plan that turned out to have no rows may end before it counts.

    The fraction of the last time has six digits, if there is one.
    """
    try:
        found = seen.get
    except Py4JJavaError:
        found = {}
    last = found.get("last_ts")
    return {"last_ts": last.ljust(26, "0") if last and "." in last else last} | {name: found.get(name, 0) for name in ("input_rows", "kept_rows", "null_users", *REASONS)}


def save_batch(spark: SparkSession, target: str, app: str, run: str, batch_id: int, counts: dict) -> None:
    """Store the counts of a batch as one row."""
    folders.put_text(spark, f"{target}/app={app}/run={run}/batch-{batch_id:010d}.json", json.dumps({"batch_id": batch_id, **counts}) + "\n")


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    """One row per batch of every stream and run."""
    if not folders.children(spark, target):
        return spark.createDataFrame([], BATCH)
    return spark.read.schema(BATCH).json(target)


class MetricsListener(StreamingQueryListener):
    """Stores each progress report of named queries with input as a row of a table."""

    def __init__(self, spark: SparkSession, target: str):
        self._spark, self._target = spark, target
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name and progress.numInputRows:
            row = {"query": progress.name, "batch_id": progress.batchId, "input_rows": progress.numInputRows}
            folders.put_text(self._spark, f"{self._target}/{progress.runId}-{progress.batchId:010d}.json", json.dumps(row) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def metrics_listener(spark: SparkSession, target: str) -> MetricsListener:
    listener = MetricsListener(spark, target)
    spark.streams.addListener(listener)
    return listener


def read_metrics(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(target)
