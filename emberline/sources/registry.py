"""The event streams, as data."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from emberline.settings import Settings


@dataclass(frozen=True)
class StreamSpec:
    kind: str
    topic: str
    max_records: int
    checkpoint: str
    target: str


# Records per batch. Topic, checkpoint and table names are ours.
STREAMS = (
    StreamSpec("ad_inflated", "ad_inflated_messages", 100_000, "ad_inflated", "hot_events"),
    StreamSpec("ad_response", "ad_responded_messages", 100_000, "ad_response", "hot_events"),
    StreamSpec("request", "request_messages", 100_000, "request", "hot_events"),
    StreamSpec("impression", "impression_messages", 100_000, "impression", "hot_events"),
    StreamSpec("click", "click_messages", 50_000, "click", "hot_events"),
    StreamSpec("attribution", "attribution_messages", 10_000, "attribution", "hot_events"),
    StreamSpec("install", "install_messages", 50_000, "install", "hot_events"),
    StreamSpec("app_event", "app_event_messages", 5_000, "app_event", "hot_events"),
    StreamSpec("vast", "vast_messages", 100_000, "vast", "hot_events"),
    StreamSpec("generic_interaction", "generic_interactions", 1_000_000, "generic_interaction", "interactions"),
    StreamSpec("ad_interaction", "ad_interactions", 10_000, "ad_interaction", "interactions"),
    StreamSpec("nrt_ad_interaction", "ad_interactions", 10_000, "nrt_ad_interaction", "hot_events"),
)

REGISTRY_SCHEMA = "kind string, topic string, max_records int, checkpoint string, target string"


def spec(kind: str) -> StreamSpec:
    for stream in STREAMS:
        if stream.kind == kind:
            return stream
    raise KeyError(f"no stream of kind {kind!r}")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([astuple(stream) for stream in STREAMS], REGISTRY_SCHEMA)


def max_age(kind: str, cfg: Settings) -> int:
    """Oldest accepted event of a stream, in days."""
    if kind == "app_event":
        return cfg.app_event_days
    return cfg.interaction_late_days if kind.endswith("interaction") else cfg.late_days
