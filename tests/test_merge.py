"""The keyed merge: order, splits, replays, hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import lookups, merge
from emberline.schema import FLAGS
from fixtures import inputs as given
from fixtures.inputs import ROW


@pytest.fixture(scope="module")
def events(spark, sf):
    return given.raw(spark, sf).cache()


@pytest.fixture(scope="module")
def whole(events):
    return sorted(map(tuple, merge.merge_lifecycle(events).select(*ROW).collect()), key=repr)


def test_merge_ignores_input_order(events, whole, rows):
    shuffled = events.orderBy(F.xxhash64("event_id")).repartition(5)
    assert rows(merge.merge_lifecycle(shuffled).select(*ROW)) == whole


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_ignores_batch_split_and_replay(events, whole, rows, seed):
    cuts = random.Random(seed).sample(range(2, 9), 3)
    batch = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(cuts[0]))
    state = None
    for i in [*range(cuts[0]), cuts[0] - 1, 0]:
        part = events.where(batch == i)
        fresh = merge.merge_states(merge.to_states(part))
        state = fresh if state is None else merge.merge_increment(state, part)
    assert rows(merge.present(state).select(*ROW)) == whole


def test_latest_value_skips_events_without_one(spark):
    at = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame(
        [
            ("u", 1, at, 1, "old"),
            ("u", 1, at + dt.timedelta(minutes=5), 2, "new"),
            ("u", 1, at + dt.timedelta(minutes=9), 3, None),
        ],
        "unique_id string, user_id bigint, ts timestamp_ntz, event_id bigint, zone string",
    ).withColumn("request_ts", F.lit(at).cast("timestamp_ntz"))
    out = merge.merge_lifecycle(df).first()
    assert out.zone == "new" and out.event_hour == 10
    assert all(out[flag] is None for flag in FLAGS)


def test_zero_flag_stays_zero_and_loses_to_one(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", 0), ("a", None), ("b", 0), ("b", 1), ("c", None)], "unique_id string, has_vast int"
    ).selectExpr("*", "1L AS user_id", f"timestamp_ntz'{at}' AS ts", f"timestamp_ntz'{at}' AS request_ts", "1L AS event_id", "'z' AS zone")
    got = {r.unique_id: r.has_vast for r in merge.merge_lifecycle(df).collect()}
    assert got == {"a": 0, "b": 1, "c": None}


def test_key_with_a_third_of_all_rows(spark, rows):
    """Brute force over rows where one key holds a third of them."""
    rnd = random.Random(7)
    at = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 400)
        data.append((i, key, at + dt.timedelta(seconds=rnd.randrange(80000)), rnd.choice([None, 0, 1])))
    df = spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp_ntz, has_click int")
    df = df.repartition(8).selectExpr("*", "cast(user_id AS string) AS unique_id", "ts AS request_ts", "cast(event_id AS string) AS zone")
    want = {}
    for i, key, ts, click in data:
        first, flag, last = want.get(key, (ts, None, (ts, i)))
        flag = click if flag is None else flag if click is None else max(flag, click)
        want[key] = (min(first, ts), flag, max(last, (ts, i)))
    got = {r.user_id: (r.request_ts, r.has_click, r.zone) for r in merge.merge_lifecycle(df).collect()}
    assert got == {k: (a, b, str(c[1])) for k, (a, b, c) in want.items()}


def test_merge_combines_before_the_shuffle(events):
    plan = merge.merge_lifecycle(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max" in plan


def test_interactions_touch_only_existing_rows(spark, rows):
    hot = spark.createDataFrame([("a", None), ("b", 1), ("c", None)], "unique_id string, has_ad_interactions int")
    seen = spark.createDataFrame([("a",)] * 5 + [("x",)], "unique_id string")
    assert rows(merge.flag_interactions(hot, seen)) == [("a", 1), ("b", 1), ("c", None)]


def test_broadcast_only_within_limit(spark, tmp_path):
    path = str(tmp_path / "dim")
    spark.range(1000).selectExpr("id AS user_id", "'n' AS nation", "'s' AS segment").write.parquet(path)
    dim = spark.read.parquet(path)
    size = lookups.planned_bytes(dim)
    marked = lookups.small_side(dim, size)._jdf.queryExecution().analyzed().toString()
    plain = lookups.small_side(dim, size - 1)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in marked and "ResolvedHint" not in plain


def test_lookup_reloads_when_old(spark):
    now = [0.0]
    side = spark.createDataFrame([(1, "x")], "user_id bigint, v string")
    lookup = lookups.Lookup(lambda: side, 120, "user_id", clock=lambda: now[0])
    batch = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    for moment, loads in ((0, 1), (119, 1), (120, 2), (130, 2), (250, 3)):
        now[0] = moment
        assert sorted(map(tuple, lookup.join(batch).collect())) == [(1, "x"), (2, None)]
        assert lookup.loads == loads


def test_flagging_takes_one_shuffle_and_equals_the_join(events, rows):
    bare, seen = events.drop("has_ad_interactions"), events.where("has_ad_interactions = 1 AND user_id % 3 = 0").select("unique_id")
    stray = seen.limit(2).select(F.lit("nobody").alias("unique_id"))
    flagged = merge.merge_flagged(bare, seen.union(stray))
    joined = merge.flag_interactions(merge.merge_lifecycle(bare), seen)
    assert rows(flagged.select(*ROW)) == rows(joined.select(*ROW))
    plain = merge.merge_flagged(bare, events.where("has_ad_interactions = 1"))
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_bucketed_tables_meet_without_an_exchange(spark, sf, tmp_path, rows):
    facts, users = given.ad_events(spark, sf), given.users(spark, sf).select("user_id", "nation", "segment")
    try:
        for name, df in (("bucket_facts", facts), ("bucket_users", users)):
            lookups.save_bucketed(df, name, str(tmp_path / name), "user_id", 4)
        got = lookups.enrich_bucketed(spark, "bucket_facts", "bucket_users")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Broadcast" not in plan
        assert rows(got) == rows(lookups.enrich(facts, users))
    finally:
        for name in ("bucket_facts", "bucket_users"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
