"""Keyed lifecycle merge.

The merge keeps, per key, the maximum of each flag, the earliest request time and
the latest value of each attribute together with the event that set it. Each of these
is associative, commutative and idempotent, so rows can be combined on the map side,
in any order, across batches, and again after a replay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.calendar import parts_of
from emberline.schema import FLAGS, PARTS, SEEN


def to_states(events: DataFrame, attributes: Sequence[str] = ("zone",), stable: Sequence[str] = ()) -> DataFrame:
    """Event rows to mergeable rows. A flag or attribute an event lacks is NULL.

    An attribute is kept with its event; it is NULL when the event has no value.
    """
    have = set(events.columns)
    return events.selectExpr(
        "unique_id",
        *stable,
        "user_id",
        "request_ts",
        *[f if f in have else f"cast(NULL AS INT) AS {f}" for f in FLAGS],
        *[
            f"if({a} IS NULL, NULL, struct(ts, event_id, {a} AS value)) AS {a}_seen"
            if a in have
            else f"cast(NULL AS {SEEN.simpleString()}) AS {a}_seen"
            for a in attributes
        ],
    )


def merge_states(states: DataFrame, attributes: Sequence[str] = ("zone",), stable: Sequence[str] = ()) -> DataFrame:
    """Fold mergeable rows to one per key.

    `stable` names columns that are constant for a key (such as its partition
    tuple). They are grouped on, so filters on them pass below the aggregation.
    """
    largest = ["user_id", *FLAGS, *[f"{a}_seen" for a in attributes]]
    return states.groupBy("unique_id", *stable).agg(
        F.min("request_ts").alias("request_ts"),
        *[F.expr(f"max({name}) AS {name}") for name in largest],
    )


def present(states: DataFrame, attributes: Sequence[str] = ("zone",)) -> DataFrame:
    """Merged rows as readers see them: plain attributes, partition tuple last."""
    hidden = {f"{a}_seen" for a in attributes} | set(PARTS)
    kept = [name for name in states.columns if name not in hidden]
    parts = PARTS if set(PARTS) <= set(states.columns) else parts_of(F.col("request_ts"))
    return states.select(
        *kept, *[F.col(f"{a}_seen.value").alias(a) for a in attributes], *parts
    )


def unfolded(states: DataFrame, details: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Mergeable rows with each mapped field as a column, in place of the details.

    A field is the value of the latest event that has one, whatever kind it is of. Each
    kind's object is decoded once.
    """
    schema = ", ".join(f"`{name}` STRING" for name in fields)
    kept = [name for name in states.columns if name not in {f"{d}_seen" for d in details}]
    parsed = [
        F.struct(F.col(f"{d}_seen.ts"), F.col(f"{d}_seen.event_id"), F.from_json(f"{d}_seen.value", schema).alias("held")).alias(d)
        for d in details
    ]

    def latest(name: str):
        seen = [
            F.expr(f"if({d}.held.`{name}` IS NULL, NULL, struct({d}.ts, {d}.event_id, {d}.held.`{name}` AS value))")
            for d in details
        ]
        return F.array_max(F.array(*seen))["value"].alias(name)

    return states.select(*kept, *parsed).select(*kept, *[latest(name) for name in fields])


def merge_lifecycle(events: DataFrame, attributes: Sequence[str] = ("zone",), stable: Sequence[str] = ()) -> DataFrame:
    """One row per `unique_id` from event rows of all kinds."""
    states = merge_states(to_states(events, attributes, stable), attributes, stable)
    return present(states, attributes)


def merge_increment(existing: DataFrame, batch: DataFrame, attributes: Sequence[str] = ("zone",)) -> DataFrame:
    """Fold a batch of events into existing mergeable rows."""
    fresh = to_states(batch, attributes)
    return merge_states(existing.select(*fresh.columns).unionByName(fresh), attributes)


def merge_flagged(
    events: DataFrame, interactions: DataFrame, attributes: Sequence[str] = ("zone",)
) -> DataFrame:
    """Merged rows of events with `has_ad_interactions` set where their key interacted.

    Interactions join the merge as states that carry the flag alone, so that flagging costs
    no shuffle of its own; a key without an event gives no row.
    """
    own = to_states(events, attributes).withColumn("_own", F.lit(1))
    seen = interactions.select("unique_id", F.lit(1).alias("has_ad_interactions"))
    states = own.unionByName(seen, allowMissingColumns=True)
    largest = [name for name in own.columns if name not in ("unique_id", "request_ts")]
    merged = states.groupBy("unique_id").agg(
        F.min("request_ts").alias("request_ts"), *[F.max(name).alias(name) for name in largest]
    )
    return present(merged.where("_own = 1").drop("_own"), attributes)


def flag_interactions(hot: DataFrame, interactions: DataFrame) -> DataFrame:
    """Set `has_ad_interactions` on hot rows whose key interacted.

    Interactions are reduced to distinct keys before they meet the hot rows, so a
    key with many interactions costs one row in the shuffle.
    """
    keys = interactions.select("unique_id").distinct().withColumn("_hit", F.lit(1))
    flag = F.greatest(F.col("has_ad_interactions"), F.col("_hit"))
    return (
        hot.join(keys, "unique_id", "left")
        .withColumn("has_ad_interactions", flag)
        .select(*hot.columns)
    )
