"""One generic query per event stream, and the simpler interaction and count streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.lookups import Lookup
from emberline.schema import DAY_PARTS
from emberline.settings import Settings
from emberline.sources.events import SPLIT, read_events
from emberline.sources.log import Topic, read_log
from emberline.sources.registry import spec
from emberline.streaming.hot import upsert
from emberline.streaming.interactions import append_part, interaction_rows
from emberline.streaming.metrics import counts_of, observed, save_batch
from emberline.streaming.rejects import decoded, evaluate, evaluation_due, judge, marked, quarantine  # noqa: F401

# Records of a limited batch up to which one task takes it whole: a shuffle costs more than it saves.
ONE_TASK_RECORDS = 20_000
# Options that a stream takes from its session: bytes of files a task reads, and rows of a block of
# a cached batch, which is built and read whole and holds messages with every mapped field.
OPTIONS = {"spark.sql.files.maxPartitionBytes": SPLIT, "spark.sql.inMemoryColumnarStorage.batchSize": "1000"}


def paced(writer, cfg: Settings, once: bool, interval: str | None = None):
    """The configured trigger or the given one, or a run that ends when the input is used up."""
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval or cfg.trigger_interval)


def run_of(batch: DataFrame) -> str:
    """The id of the query a batch belongs to. It lives as long as its checkpoint.

    A fresh checkpoint counts batches from 0 again; with the id in their names, its
    parts stand beside those of the one before instead of replacing them.
    """
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def run_stream(
    spark: SparkSession,
    kind: str,
    source: DataFrame | Topic | str,
    root: str,
    as_of: Callable[[], dt.date],
    cfg: Settings = Settings(),
    once: bool = False,
    interval: str | None = None,
    after: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Start the stream of one kind into the tables under `root`.

    Messages are decoded in the plan of the stream, which is made once, not for each batch;
    each batch is decoded and judged once. Good rows are upserted into the hot table
    or appended to the interactions. The write itself counts the batch and its rejects;
    those of enabled streams are quarantined too. All writes are keyed by stream, checkpoint
    and batch number, so a batch that runs again after a failure leaves the same tables.
    `as_of` is asked at every batch, because a stream outlives a date. Of a topic a batch
    takes at most the records that the registry allows the stream; with `once` that is
    one batch, and `drain` goes on until the topic is used up. Where that is few records, one
    task takes the batch whole. `interval` is a trigger
    pace in place of the configured one; `after` is told the number of each batch done.
    """
    stream = spec(kind)
    save = append_part if stream.target == "interactions" else upsert
    target, bad, reports = f"{root}/{stream.target}", f"{root}/bad_records", f"{root}/bad_reports"
    counted = f"{root}/batch_metrics"
    every = cfg.bad_record_every.get(kind, 0)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        judged = marked(batch, kind, as_of(), cfg)
        routed = kind in cfg.bad_record_kinds
        cached = kind in cfg.cached_kinds
        run = run_of(batch)
        judged, seen = observed(judged)
        if cached:
            judged = judged.persist()
        try:
            save(judged.where(F.col("reason").isNull()), batch_id, target, f"{kind}-{run}", few)
            counts = counts_of(seen)
            save_batch(spark, counted, kind, run, batch_id, counts)
            if routed:
                rejects = judged.where(F.col("reason").isNotNull())
                quarantine(rejects, kind, batch_id, bad, run, counts["input_rows"] - counts["kept_rows"])
                if every and evaluation_due(batch_id, every):
                    report = evaluate(spark, bad, kind, batch_id, every, run)
                    report.write.mode("overwrite").parquet(f"{reports}/app={kind}/run={run}/at={batch_id}")
        finally:
            if cached:
                judged.unpersist()
        if after:
            after(batch_id)

    few = isinstance(source, Topic) and stream.max_records <= ONE_TASK_RECORDS
    if isinstance(source, Topic):
        messages = read_log(spark, source, stream.max_records, few).select("event_id", "payload")
    else:
        messages = read_events(spark, kind, source, cfg) if isinstance(source, str) else source
    writer = (
        decoded(messages, kind).writeStream.queryName(f"{kind}-{root.rsplit('/', 1)[-1]}")
        .foreachBatch(on_batch)
        .option("checkpointLocation", f"{root}/checkpoints/{stream.checkpoint}")
    )
    # A stream keeps the options its session has at the start.
    before = {name: spark.conf.get(name) for name in OPTIONS}
    try:
        for name, value in OPTIONS.items():
            spark.conf.set(name, value)
        return paced(writer, cfg, once, interval).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def drain(
    spark: SparkSession,
    kind: str,
    topic: Topic,
    root: str,
    as_of: Callable[[], dt.date],
    cfg: Settings = Settings(),
) -> int:
    """Take a topic to its end, a limited batch at a time; return the batches.

    One query goes on from the checkpoint, batch after batch, until the log has no more.
    """
    batches = []
    query = run_stream(spark, kind, topic, root, as_of, cfg, interval="0 seconds", after=batches.append)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return len(batches)


def state_in_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from here on in RocksDB, with changes as checkpoints.

    State then lives on the executors' disks instead of their heaps, and a checkpoint is as
    large as what a batch changed.
    """
    state = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{state}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{state}.rocksdb.changelogCheckpointing.enabled", "true")


def deduplicated(stream: DataFrame, key: str = "event_id", ts: str = "ts", within: str = "2 days") -> DataFrame:
    """The first event of each key; copies come within the given time of it.

    State expires with the watermark. Needs a session in UTC, as watermarks need a zoned time.
    """
    zoned = stream.withColumn("_zoned", F.col(ts).cast("timestamp")).withWatermark("_zoned", within)
    return zoned.dropDuplicatesWithinWatermark([key]).drop("_zoned")


def append_interactions(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    cfg: Settings = Settings(),
    once: bool = False,
    name: str | None = None,
    within: str | None = None,
) -> StreamingQuery:
    """Append decoded interaction events to a table of their own, one folder per day.

    With `within` an event that comes again in that time, as from a replayed feed, is left out.
    """
    writer = (
        interaction_rows(deduplicated(stream, within=within) if within else stream)
        .writeStream.format("parquet")
        .partitionBy(*DAY_PARTS)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )
    return paced(writer.queryName(name) if name else writer, cfg, once).start()


def run_lookup(
    stream: DataFrame, side: Lookup, target: str, checkpoint: str, cfg: Settings = Settings(), once: bool = False
) -> StreamingQuery:
    """Join each batch to the lookup as it stands; a batch owns its output folder."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        side.join(batch).write.mode("overwrite").parquet(f"{target}/run={run_of(batch)}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return paced(writer, cfg, once).start()


def stream_counts(stream: DataFrame, late: str = "6 days") -> DataFrame:
    """Events per hour and type, kept incrementally; state expires with the watermark.

    Watermarks need a zoned time, so the session must run in UTC.
    """
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("rows"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "rows")
    )


def rollup(stream: DataFrame, late: str = "6 days") -> tuple[DataFrame, DataFrame]:
    """Events per hour and type, and per day and type with the busiest hour.

    The daily counts are a second stateful step over the hourly windows of the same
    stream. Both are final when they come out: append mode, once the watermark has passed.
    """
    hours = (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("rows"))
    )
    days = (
        hours.groupBy(F.window(F.window_time("w"), "1 day").alias("d"), "event_type")
        .agg(F.sum("rows").alias("rows"), F.max("rows").alias("busiest"))
        .select(F.col("d.start").cast("date").alias("event_date"), "event_type", "rows", "busiest")
    )
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "rows"), days


def run_rollup(
    counts: DataFrame, target: str, checkpoint: str, cfg: Settings = Settings(), once: bool = False
) -> StreamingQuery:
    """Append final windows to a table."""
    writer = counts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return paced(writer, cfg, once).start()


def run_counts(
    counts: DataFrame, target: str, checkpoint: str, cfg: Settings = Settings(), once: bool = False
) -> StreamingQuery:
    """Store the windows each batch changed."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/run={run_of(batch)}/batch_id={batch_id}")

    writer = (
        counts.writeStream.outputMode("update")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
    )
    return paced(writer, cfg, once).start()


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """Current count of each window: counts only grow, so the largest is the latest."""
    return (
        spark.read.parquet(target)
        .groupBy("window_start", "event_type")
        .agg(F.max("rows").alias("rows"))
    )


def freshness(df: DataFrame, streams: DataFrame, as_of: dt.datetime, limit_hours: int) -> DataFrame:
    """Last event and lag of every registered stream; one never seen is stale."""
    last = df.groupBy("kind").agg(F.max("ts").alias("last_ts"))
    lag = F.timestamp_diff("HOUR", F.col("last_ts"), F.lit(as_of).cast("timestamp_ntz"))
    return (
        streams.select("kind")
        .join(last, "kind", "left")
        .select(
            "kind",
            "last_ts",
            lag.alias("lag_hours"),
            F.coalesce(lag > limit_hours, F.lit(True)).alias("stale"),
        )
    )
