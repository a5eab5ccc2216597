"""Bad records: why a message is rejected, where it goes, when it is reported."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.columns import parse
from emberline.operators.filters import lateness
from emberline.schema import INTERACTION_FIELDS, PAYLOAD_FIELDS, QUARANTINE, REASONS
from emberline.settings import Settings
from emberline.sources import folders
from emberline.sources.registry import max_age, spec
from emberline.streaming.metrics import read_batches


def decoded(messages: DataFrame, kind: str) -> DataFrame:
    """Messages of a kind with their fields as columns, and what is wrong with their text.

    An interaction is asked only for the fields its table keeps. Of other messages the
    mapped fields come along, as the details of their kind.
    """
    if spec(kind).target == "interactions":
        return parse(messages, INTERACTION_FIELDS)
    return parse(messages, PAYLOAD_FIELDS, f"{kind}_details")


def marked(events: DataFrame, kind: str, as_of: dt.date, cfg: Settings = Settings()) -> DataFrame:
    """Decoded messages with `reason`, NULL for the good ones."""
    key, day = ("event_id", "ts") if spec(kind).target == "interactions" else ("unique_id", "request_ts")
    reason = (
        F.when(F.col("corrupt").isNotNull(), "unparseable")
        .when(F.col("bad_value"), "bad_value")
        .when(F.col(key).isNull(), "missing_key")
        .when(F.col("ts").isNull() | F.col(day).isNull(), "bad_value")
        .otherwise(lateness(F.col(day).cast("date"), as_of, max_age(kind, cfg), cfg.create_ahead))
    )
    return events.select(*[name for name in events.columns if name not in ("corrupt", "bad_value")], reason.alias("reason"))


def judge(messages: DataFrame, kind: str, as_of: dt.date, cfg: Settings = Settings()) -> DataFrame:
    """Decoded messages with `reason`, NULL for the good ones."""
    return marked(decoded(messages, kind), kind, as_of, cfg)


def batch_dir(target: str, app: str, run: str, batch_id: int) -> str:
    """The folder of a batch: `run` is the query's id, which a new checkpoint changes."""
    return f"{target}/app={app}/run={run}/batch_id={batch_id}"


def read_reject_counts(spark: SparkSession, target: str) -> DataFrame:
    """Rejects by stream, run, batch and reason, from the batches' metrics."""
    counts = F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("rows")) for name in REASONS])
    found = read_batches(spark, target).select("app", "run", "batch_id", F.inline(counts))
    return found.where("rows > 0")


def quarantine(rejects: DataFrame, app: str, batch_id: int, target: str, run: str = "batch", count: int | None = None) -> None:
    """Write the rejects of a batch to their own folder; a replay replaces it.

    A batch without rejects, the usual case, leaves no folder: `count` tells, where they
    were counted before.
    """
    folder = batch_dir(target, app, run, batch_id)
    if rejects.isEmpty() if count is None else not count:
        folders.delete(rejects.sparkSession, folder)
    else:
        rejects.select("reason", "payload").write.mode("overwrite").parquet(folder)


def read_quarantine(spark: SparkSession, target: str) -> DataFrame:
    if not folders.children(spark, target):
        return spark.createDataFrame([], QUARANTINE).select("app", "batch_id", "reason", "payload")
    return spark.read.schema(QUARANTINE).parquet(target).select(
        "app", "batch_id", "reason", "payload"
    )


def evaluation_due(batch_id: int, every: int) -> bool:
    return batch_id % every == 0


def evaluate(
    spark: SparkSession, quarantine_dir: str, app: str, batch_id: int, every: int, run: str = "batch"
) -> DataFrame:
    """Rejects by reason over the batches since the last evaluation.

    Only the folders of those batches are opened, by name.
    """
    span = [batch_dir(quarantine_dir, app, run, n) for n in range(max(0, batch_id - every + 1), batch_id + 1)]
    held = [folder for folder in span if folders.exists(spark, folder)]
    rows = spark.read.schema("reason string").parquet(*held) if held else spark.createDataFrame([], "reason string")
    return (
        rows.groupBy("reason")
        .agg(F.count("*").alias("rows"))
        .select(F.lit(app).alias("app"), F.lit(batch_id).cast("bigint").alias("batch_id"), "reason", "rows")
    )
