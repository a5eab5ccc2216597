"""Warehouse inputs derived from the given tables. Nothing is made up or stored here."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.filters import classify
from emberline.operators.merge import merge_lifecycle
from emberline.schema import FLAGS, PARTS

JOB = "profile_hourly"
AS_OF = dt.date(2024, 1, 30)
D7 = dt.date(2024, 1, 23)
D15 = dt.date(2024, 1, 15)
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 30)

ROW = ["unique_id", "user_id", "request_ts", *FLAGS, "zone", *PARTS]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event with its key and flags; `request_ts` is the event's own time."""
    events = table(spark, sf, "events").selectExpr(
        "*", "cast(ts AS DATE) AS event_date", "cast(get_json_object(props, '$.k') AS INT) AS k"
    )
    conditions = {
        "has_request": "user_id % 11 <> 0",
        "has_response": "event_type <> 'error'",
        "has_impression": "event_type = 'view'",
        "has_click": "event_type = 'click'",
        "has_install": "event_type = 'purchase'",
        "has_lead": "event_type = 'signup'",
        "has_postinstall": "event_type = 'purchase' AND value > 100",
        "has_vast": "event_type = 'view' AND k >= 80",
        "has_ad_interactions": "k % 10 = 0",
    }
    return events.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "ts AS request_ts",
        "event_date",
        "concat(cast(user_id AS STRING), '-', cast(event_date AS STRING)) AS unique_id",
        "event_type",
        "value",
        "k",
        "concat('zone_', cast(k % 9 AS STRING)) AS zone",
        *[f"CASE WHEN {conditions[flag]} THEN 1 END AS {flag}" for flag in FLAGS],
    )


def ad_events_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the request time of their key: its first event.

    The minimum is combined on the map side and joined back, so that a key with very
    many events is never gathered in one task as a window would do; adaptive
    execution splits its rows in the join.
    """
    events = raw(spark, sf).drop("request_ts")
    first = events.groupBy("user_id", "event_date").agg(F.min("ts").alias("request_ts"))
    return events.join(first, ["user_id", "event_date"])


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Merged rows with their date. The key's date is fixed, so filters on it reach
    the scan; the earliest event time becomes the request time in the same pass."""
    return merge_lifecycle(raw(spark, sf), stable=["event_date"])


def ad_events(spark: SparkSession, sf: str) -> DataFrame:
    return dated(spark, sf).select(*ROW)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify(dated(spark, sf)).select(*ROW, "event_date", "event_class")


def hot_events(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).where(F.col("event_date") >= F.lit(D7))


def cold_events(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).where(
        (F.col("event_class") != "unclassified")
        & (F.col("event_date") <= F.lit(D7))
        & ((F.col("event_date") > F.lit(D15)) | (F.col("has_click") == 1))
    )


def cold_defect(spark: SparkSession, sf: str) -> DataFrame:
    """Cold rows that lost some users on odd days."""
    lost = (F.col("user_id") % 50 == 7) & (F.dayofmonth("event_date") % 2 == 1)
    return classified(spark, sf).where((F.col("event_class") != "unclassified") & ~lost)


def zero_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Merged rows where some users carry a 0 instead of no video flag."""
    zero = F.when(F.col("has_vast").isNull() & (F.col("user_id") % 13 == 0), 0)
    return ad_events(spark, sf).withColumn("has_vast", F.coalesce("has_vast", zero))


def users(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            "nation",
            F.col("c_mktsegment").alias("segment"),
        )
    )


def user_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each user: the account itself, then one per order, whose priority
    stands for the segment."""
    base = users(spark, sf)
    accounts = base.select(
        "*",
        F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz").alias("updated_at"),
        F.lit(-1).cast("bigint").alias("doc_id"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderpriority").alias("segment"),
    )
    versions = orders.join(base.drop("segment"), "user_id")
    return accounts.unionByName(versions)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Job rows for the hours 0 to 22 of one date; every fifth is open.

    Another job has the same hours, done where the first is open and the other way round.
    """
    h = F.col("h")
    hours = table(spark, sf, "events").select(F.hour("ts").alias("h")).distinct().where(h < 23)
    jobs = F.explode(F.array(F.lit(JOB), F.lit("other")))
    hours = hours.select("h", jobs.alias("job_name"))
    open_ = (h % 5 == 0) == (F.col("job_name") == JOB)
    fixed = {"year": 2024, "month": 1, "day": 29}
    return hours.select(
        "job_name",
        *[F.lit(v).alias(f"current_{n}") for n, v in fixed.items()],
        h.alias("current_hour"),
        *[F.lit(v).alias(f"next_{n}") for n, v in fixed.items()],
        (h + 1).alias("next_hour"),
        F.lit(4).alias("week_number"),
        F.when(open_, 0).otherwise(1).alias("is_processed"),
        (1 + h % 3).cast("int").alias("retries"),
    )


# The stream that carries each event type.
KINDS = {
    "view": "impression",
    "click": "click",
    "purchase": "install",
    "signup": "app_event",
    "error": "request",
}


def stream_kind() -> Column:
    kind = F.col("event_type")
    out = None
    for event_type, name in KINDS.items():
        out = F.when(kind == event_type, name) if out is None else out.when(kind == event_type, name)
    return out


def messages(spark: SparkSession, sf: str, dirty: bool = False) -> DataFrame:
    """Events as JSON messages, with the date and stream they belong to.

    Dirty ones are cut off, lack the key, or hold text where a number belongs.
    """
    number = F.col("event_id")

    def quoted(column) -> Column:
        return F.concat(F.lit('"'), column, F.lit('"'))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    key, request = quoted(F.col("unique_id")), flag("has_request")
    if dirty:
        key = F.when(number % 89 == 0, "null").otherwise(key)
        request = F.when(number % 83 == 0, '"x"').otherwise(request)
    fields = {
        "event_id": number.cast("string"),
        "uniqueId": key,
        "topology_entry_time": quoted(F.col("ts").cast("string")),
        "request_timestamp": quoted(F.col("request_ts").cast("string")),
        "user_id": F.col("user_id").cast("string"),
        "zone": quoted(F.col("zone")),
        "event_type": quoted(F.col("event_type")),
        # Mapped fields, each by its source name.
        "cellid": F.col("k").cast("string"),
        "topicname": quoted(F.col("event_type")),
        "appid": F.when(F.col("k") % 2 == 0, quoted(F.concat(F.lit("app"), F.col("k").cast("string")))).otherwise("null"),
        "has_request": request,
        **{name: flag(name) for name in FLAGS if name != "has_request"},
    }
    pieces = []
    for i, (name, value) in enumerate(fields.items()):
        pieces += [F.lit(f'{"," if i else "{"}"{name}":'), value]
    payload = F.concat(*pieces, F.lit("}"))
    if dirty:
        length = F.when(number % 97 == 0, 40).otherwise(2**31 - 1)
        payload = payload.substr(F.lit(1), length)
    return ad_events_raw(spark, sf).select(
        "event_id", payload.alias("payload"), "event_date", stream_kind().alias("kind")
    )
