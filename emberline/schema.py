"""Column names and row types of the event warehouse."""

from __future__ import annotations

from pyspark.sql import types as T

# The partition tuple, always four integers, always last.
PARTS = ["event_year", "event_month", "event_day", "event_hour"]

# Lifecycle flags. 1 or NULL; a 0 can arrive and must stay a 0.
FLAGS = [
    "has_request",
    "has_response",
    "has_impression",
    "has_click",
    "has_install",
    "has_lead",
    "has_postinstall",
    "has_vast",
    "has_ad_interactions",
]

# Any of these at 1 puts a row in the fill class.
OUTCOMES = [
    "has_impression",
    "has_click",
    "has_install",
    "has_lead",
    "has_postinstall",
    "has_vast",
]

# Columns of the profile job ledger.
LEDGER = [
    "job_name",
    "current_year",
    "current_month",
    "current_day",
    "current_hour",
    "next_year",
    "next_month",
    "next_day",
    "next_hour",
    "week_number",
    "is_processed",
    "retries",
]

# The latest value of an attribute with the event that set it, so that a later
# merge can still compare.
SEEN = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

# Kinds of events that make up a hot row, and the column that holds the latest mapped
# fields of each kind: the fields as a JSON object, with the event they came with.
HOT_KINDS = [
    "ad_inflated",
    "ad_response",
    "request",
    "impression",
    "click",
    "attribution",
    "install",
    "app_event",
    "vast",
    "nrt_ad_interaction",
]
DETAILS = [f"{kind}_details" for kind in HOT_KINDS]

# What the merge keeps the latest value of.
HOT_ATTRIBUTES = ["zone", *DETAILS]

# Hot folders are half-day ranges, named by the hour they start at.
RANGES = ["event_year", "event_month", "event_day", "lower_hour"]

# Stored hot row: mergeable state.
HOT = T.StructType(
    [
        T.StructField("unique_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("request_ts", T.TimestampNTZType()),
        *[T.StructField(flag, T.IntegerType()) for flag in FLAGS],
        *[T.StructField(f"{name}_seen", SEEN) for name in HOT_ATTRIBUTES],
        T.StructField("event_hour", T.IntegerType()),
        *[T.StructField(part, T.IntegerType()) for part in RANGES],
    ]
)

# Event as decoded from a message payload; the names on the right are ours.
# The payload field for key, event time and request time.
PAYLOAD_FIELDS = {
    "uniqueId": ("unique_id", "string"),
    "topology_entry_time": ("ts", "timestamp_ntz"),
    "request_timestamp": ("request_ts", "timestamp_ntz"),
    "event_id": ("event_id", "bigint"),
    "user_id": ("user_id", "bigint"),
    "zone": ("zone", "string"),
    "event_type": ("event_type", "string"),
    **{flag: (flag, "int") for flag in FLAGS},
}

# What an interaction needs, by the same names.
INTERACTION_FIELDS = {
    field: PAYLOAD_FIELDS[field] for field in ("topology_entry_time", "event_id", "user_id", "event_type")
}

MESSAGE = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("payload", T.StringType())]
)

# Interactions are kept by whole days.
DAY_PARTS = ["event_year", "event_month", "event_day"]

INTERACTION = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_hour", T.IntegerType()),
        *[T.StructField(part, T.IntegerType()) for part in DAY_PARTS],
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("app", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# Why a message is rejected.
REASONS = ["unparseable", "bad_value", "missing_key", "too_late", "future"]

# What a batch's write has counted.
BATCH = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("last_ts", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in ("input_rows", "kept_rows", "null_users", *REASONS)],
        T.StructField("app", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)
