"""Event stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.schema import MESSAGE
from emberline.settings import Settings
from emberline.sources.registry import spec

# Bytes of a row group of a feed that is written here.
ROW_GROUP = 16 << 20
# Bytes of stored messages that a task of a stream takes: decoded and cached they are ten times as many or more.
SPLIT = "8m"


def read_events(
    spark: SparkSession,
    kind: str,
    path: str,
    cfg: Settings = Settings(),
    schema=MESSAGE,
    glob: str | None = None,
) -> DataFrame:
    """Stream of one kind from parquet files arriving under `path`."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if cfg.max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", cfg.max_files_per_trigger)
    return reader.parquet(path)


def read_topic(spark: SparkSession, kind: str, servers: str) -> DataFrame:
    """Stream of one kind from its message topic. Needs the Kafka connector."""
    stream = spec(kind)
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", stream.topic)
        .option("maxOffsetsPerTrigger", stream.max_records)
        .load()
    )
    return rows.select(
        F.col("offset").alias("event_id"), F.col("value").cast("string").alias("payload")
    )
