"""Streams: replay, restart, crash, rejects, folding."""

import datetime as dt
import os
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberline.schema import RANGES
from emberline.sources import folders, registry
from emberline.sources.registry import STREAMS
from emberline.streaming import hot as hot_store
from emberline.streaming import interactions, metrics, rejects, run
from fixtures import checks
from fixtures import inputs as given
from fixtures.checks import OPEN
from fixtures.inputs import AS_OF, ROW

DAYS = "event_date between '2024-01-02' and '2024-01-06'"


@pytest.fixture(scope="module")
def feed(spark, sf):
    few = given.messages(spark, sf).where(DAYS)
    return few.select("event_id", "payload", "event_date").cache()


@pytest.fixture(scope="module")
def whole(spark, sf):
    return sorted(map(tuple, given.dated(spark, sf).where(DAYS).select(*ROW).collect()), key=repr)


def play(spark, source, root, kind="request", cfg=OPEN):
    q = run.run_stream(spark, kind, source, root, lambda: AS_OF, cfg, once=True)
    q.awaitTermination()
    return q


def test_replay_from_a_fresh_checkpoint_changes_nothing(spark, feed, whole, rows, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    feed.drop("event_date").repartition(4).write.parquet(src)
    play(spark, src, root, cfg=replace(OPEN, max_files_per_trigger=1))
    hot = f"{root}/hot_events"
    assert len(folders.children(spark, hot)) == 4
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole
    folders.move(spark, f"{root}/checkpoints", str(tmp_path / "old"))
    play(spark, src, root)
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole
    assert sum(p.numInputRows for p in play(spark, src, root).recentProgress) == 0


def test_crash_between_writes_is_repaired_by_the_rerun(spark, feed, whole, rows, tmp_path, monkeypatch):
    """The batch fails after its hot part is written, before it is committed."""
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    feed.drop("event_date").write.parquet(src)

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(run, "quarantine", fail)
    with pytest.raises(Exception, match="lost"):
        play(spark, src, root)
    monkeypatch.undo()
    play(spark, src, root)
    assert rows(hot_store.read_hot(spark, f"{root}/hot_events").select(*ROW)) == whole


def test_batch_without_rejects_leaves_no_folder(spark, tmp_path):
    judged = spark.createDataFrame([("unparseable", "{bad")], "reason string, payload string")
    target = str(tmp_path / "bad")
    rejects.quarantine(judged, "click", 3, target)
    assert rejects.read_quarantine(spark, target).count() == 1
    rejects.quarantine(judged.where("false"), "click", 3, target)
    rejects.quarantine(judged.where("false"), "click", 4, target)
    assert rejects.read_quarantine(spark, target).count() == 0
    assert rejects.evaluate(spark, target, "click", 4, 2).count() == 0


def test_fold_keeps_rows_and_can_be_cut_short(spark, feed, whole, rows, tmp_path, monkeypatch):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    hot = f"{root}/hot_events"
    feed.drop("event_date").repartition(3).write.parquet(src)
    play(spark, src, root, cfg=replace(OPEN, max_files_per_trigger=1))
    monkeypatch.setattr(hot_store.folders, "delete", lambda *a: False)
    assert hot_store.fold(spark, hot, 2)
    monkeypatch.undo()
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole
    hot_store.fold(spark, hot, 2)
    assert hot_store.fold(spark, hot, 2) == []
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole


def test_fold_leaves_unfinished_parts_alone(spark, feed, whole, rows, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    hot = f"{root}/hot_events"
    feed.drop("event_date").repartition(3).write.parquet(src)
    play(spark, src, root, cfg=replace(OPEN, max_files_per_trigger=1))
    unfinished = next(part for part in folders.children(spark, hot) if part.endswith("-0000000001"))
    folders.delete(spark, f"{hot}/{unfinished}/_SUCCESS")
    before = folders.partition_dirs(spark, f"{hot}/{unfinished}", RANGES)
    assert hot_store.fold(spark, hot, 2)
    assert folders.partition_dirs(spark, f"{hot}/{unfinished}", RANGES) == before
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole


def test_fold_removes_spent_parts(spark, feed, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    hot = f"{root}/hot_events"
    feed.drop("event_date").limit(40).write.parquet(src)
    play(spark, src, root)
    hot_store.fold(spark, hot, 1)
    assert [part.split("-")[0] for part in folders.children(spark, hot)] == ["part=fold"]


def test_hot_reads_prune_partitions(spark, feed, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    feed.drop("event_date").write.parquet(src)
    play(spark, src, root)
    hot = f"{root}/hot_events"
    one = hot_store.read_hot(spark, hot).where("event_day = 3 AND event_hour = 4")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(event_day#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "EqualTo(event_hour,4)" in plan.split("PushedFilters: [")[1]
    cut = hot_store.stored(spark, hot).where(
        hot_store.range_number(*map(F.col, RANGES)).isin(2024010300, 2024010312)
    )
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "event_year#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert len(folders.partition_dirs(spark, hot, ["part", *RANGES])) <= 10


def test_empty_hot_table_reads_empty(spark, tmp_path):
    assert hot_store.read_hot(spark, str(tmp_path / "none")).count() == 0


def test_bad_rows_land_in_quarantine_only(spark, sf, tmp_path):
    at = "2024-01-30 10:00:00"

    def text(key, ts=at, extra=""):  # request and event time move together here
        return f'{{"uniqueId":"{key}","event_id":1,"user_id":1,"topology_entry_time":"{ts}","request_timestamp":"{ts}"{extra}}}'

    payloads = {
        "good": text("g"),
        "unparseable": "{bad",
        "bad_value": text("b", extra=',"has_click":"x"'),
        "missing_key": text("m").replace('"uniqueId":"m",', ""),
        "too_late": text("l", "2024-01-23 10:00:00"),
        "future": text("f", "2024-02-02 10:00:00"),
    }
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    spark.createDataFrame([(1, p) for p in payloads.values()], "event_id bigint, payload string").write.parquet(src)
    play(spark, src, root, "click", replace(OPEN, late_days=6))
    held = {r.payload: r.reason for r in rejects.read_quarantine(spark, f"{root}/bad_records").collect()}
    assert held == {p: reason for reason, p in payloads.items() if reason != "good"}
    assert [r.unique_id for r in hot_store.read_hot(spark, f"{root}/hot_events").collect()] == ["g"]


def text(key, ts="2024-01-30 10:00:00", extra="", number=1):
    return (
        f'{{"uniqueId":"{key}","event_id":{number},"user_id":1,"topology_entry_time":"{ts}",'
        f'"request_timestamp":"2024-01-30 10:00:00"{extra}}}'
    )


def arrive(spark, path, *payloads):
    spark.createDataFrame([(1, p) for p in payloads], "event_id bigint, payload string").write.mode("append").parquet(path)


def test_streams_meet_in_one_row(spark, tmp_path):
    """The interaction stream flags the row that request and click made."""
    root = str(tmp_path / "t")
    for kind, flag in (("request", "has_request"), ("nrt_ad_interaction", "has_ad_interactions"), ("click", "has_click")):
        arrive(spark, str(tmp_path / kind), text("u", extra=f',"{flag}":1'))
        play(spark, str(tmp_path / kind), root, kind)
    (row,) = hot_store.read_hot(spark, f"{root}/hot_events").collect()
    assert (row.has_request, row.has_click, row.has_ad_interactions, row.has_install) == (1, 1, 1, None)


def test_interactions_are_appended_and_late_ones_left_out(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    arrive(spark, src, text("a", number=1), text("a", number=2), text("b", "2024-01-27 23:59:59", number=3))
    play(spark, src, root, "generic_interaction", replace(OPEN, interaction_late_days=2))
    arrive(spark, src, text("a", "2024-01-28 00:00:00", number=4))
    play(spark, src, root, "generic_interaction", replace(OPEN, interaction_late_days=2))
    got = interactions.read_interactions(spark, f"{root}/interactions").collect()
    assert sorted((r.event_id, r.event_day, r.event_hour) for r in got) == [(1, 30, 10), (2, 30, 10), (4, 28, 0)]


def test_hourly_counts_grow_over_restarts(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")

    def feed_and_run(*times):
        rows = [(dt.datetime.fromisoformat(t), "click") for t in times]
        df = spark.createDataFrame(rows, "ts timestamp, event_type string")
        df.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type").write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(src)
        run.run_counts(run.stream_counts(stream), out, mark, once=True).awaitTermination()
        return {r.window_start.hour: r.rows for r in run.read_counts(spark, out).where("window_start >= '2024-01-10'").collect()}

    assert feed_and_run("2024-01-10 01:10:00", "2024-01-10 01:20:00", "2024-01-10 02:00:00") == {1: 2, 2: 1}
    assert feed_and_run("2024-01-10 01:59:59", "2024-01-10 03:00:00") == {1: 3, 2: 1, 3: 1}
    assert feed_and_run("2024-01-01 05:00:00") == {1: 3, 2: 1, 3: 1}


def test_rejects_of_other_streams_are_counted_but_not_kept(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    arrive(spark, src, "{bad", "{worse", text("a"))
    play(spark, src, root, "vast")
    assert not os.path.exists(f"{root}/bad_records")
    counted = rejects.read_reject_counts(spark, f"{root}/batch_metrics").collect()
    assert [(r.app, r.batch_id, r.reason, r.rows) for r in counted] == [("vast", 0, "unparseable", 2)]


def test_a_fresh_checkpoint_keeps_what_was_stored(spark, tmp_path):
    """Batches are counted from 0 again, over new messages."""
    root = str(tmp_path / "t")
    for i, key in enumerate("abc"):
        src = str(tmp_path / f"src{i}")
        arrive(spark, src, text(key), "{bad" + key)
        play(spark, src, root, "click")
        folders.move(spark, f"{root}/checkpoints", str(tmp_path / f"old{i}"))
    assert sorted(r.unique_id for r in hot_store.read_hot(spark, f"{root}/hot_events").collect()) == ["a", "b", "c"]
    assert sorted(r.payload for r in rejects.read_quarantine(spark, f"{root}/bad_records").collect()) == ["{bada", "{badb", "{badc"]


def test_batch_borders_change_nothing(spark, tmp_path):
    """Messages of one key whose request times lie in two hours."""
    def message(hour):
        return text("u").replace('"request_timestamp":"2024-01-30 10', f'"request_timestamp":"2024-01-30 {hour}')

    got = []
    for name, batches in (("one", [["10", "11"]]), ("two", [["10"], ["11"]])):
        src, root = str(tmp_path / f"src-{name}"), str(tmp_path / name)
        for hours in batches:
            arrive(spark, src, *map(message, hours))
            play(spark, src, root, "click")
        got.append(sorted(r.event_hour for r in hot_store.read_hot(spark, f"{root}/hot_events").collect()))
    assert got == [[10, 11], [10, 11]]


def test_an_interaction_needs_only_what_its_table_keeps(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    bare = '{"event_id":7,"user_id":1,"topology_entry_time":"2024-01-30 10:00:00"}'
    arrive(spark, src, bare, bare.replace('"event_id":7,', ""))
    play(spark, src, root, "generic_interaction")
    assert [r.event_id for r in interactions.read_interactions(spark, f"{root}/interactions").collect()] == [7]
    assert [r.reason for r in rejects.read_reject_counts(spark, f"{root}/batch_metrics").collect()] == ["missing_key"]


def test_a_lookup_outlives_its_files(spark, tmp_path):
    from emberline.operators.lookups import Lookup

    path, clock = str(tmp_path / "side"), [0.0]
    side = Lookup(lambda: spark.read.parquet(path), 100, "k", clock=lambda: clock[0])
    batch = spark.createDataFrame([(1,), (2,)], "k int")

    def store(value):
        """As another process does it: the file that was loaded is gone."""
        for name in os.listdir(path) if os.path.isdir(path) else []:
            os.remove(f"{path}/{name}")
        os.makedirs(path, exist_ok=True)
        pq.write_table(pa.table({"k": pa.array([1], pa.int32()), "v": [value]}), f"{path}/{value}.parquet")

    store("old")
    assert {r.k: r.v for r in side.join(batch).collect()} == {1: "old", 2: None}
    store("new")
    assert {r.k: r.v for r in side.join(batch).collect()} == {1: "old", 2: None}
    clock[0] = 200.0
    assert {r.k: r.v for r in side.join(batch).collect()} == {1: "new", 2: None}
    assert side.loads == 2


def test_evaluation_covers_every_batch_once():
    every = 3
    covered = []
    for batch_id in range(10):
        if rejects.evaluation_due(batch_id, every):
            covered += range(max(0, batch_id - every + 1), batch_id + 1)
    assert covered == list(range(10))


def test_registry_lists_twelve_streams(spark):
    assert registry.registry(spark).count() == len(STREAMS) == 12
    assert registry.spec("click").max_records == 50_000
    with pytest.raises(KeyError):
        registry.spec("other")
    assert [registry.max_age(k, replace(OPEN, late_days=6, interaction_late_days=2, app_event_days=20))
            for k in ("click", "ad_interaction", "app_event")] == [6, 2, 20]


def test_trigger_is_the_configured_interval(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    spark.createDataFrame([], "event_id bigint, payload string").write.parquet(src)
    q = run.run_stream(spark, "click", src, root, lambda: AS_OF, OPEN)
    try:
        assert "15000" in str(q._jsq.toString()) or q.isActive
    finally:
        q.stop()


def test_freshness_flags_silent_streams(spark):
    seen = spark.createDataFrame(
        [("click", dt.datetime(2024, 1, 30, 20)), ("install", dt.datetime(2024, 1, 30, 23, 30))], "kind string, ts timestamp"
    ).select("kind", F.col("ts").cast("timestamp_ntz").alias("ts"))
    got = {r.kind: (r.lag_hours, r.stale) for r in run.freshness(seen, registry.registry(spark), dt.datetime(2024, 1, 31), 1).collect()}
    assert got["click"] == (4, True) and got["install"] == (0, False) and got["vast"] == (None, True)


def test_workspace_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = folders.workspace(spark, "x")
    assert path.startswith(shared) if shared else path.endswith("/x")


def test_mapped_fields_reach_the_hot_row_and_the_cold_tables(spark, tmp_path):
    """Each kind keeps its latest fields; a field is the latest value of any kind."""
    from emberline.functions.columns import mapped_targets
    from emberline.sources import cold

    root = str(tmp_path / "t")
    steps = [
        ("request", "10:00:00", ',"has_request":1,"gpscountry":"IN","clientid":"c1","cellid":7'),
        ("click", "10:05:00", ',"has_click":1,"gpscountry":null,"topicid":"t"'),
        ("click", "10:04:00", ',"has_click":1,"topicid":"older","pubname":"p"'),
        ("impression", "10:02:00", ',"has_impression":1,"clientid":"c2","app_id":"a2"'),
    ]
    for i, (kind, at, extra) in enumerate(steps):
        arrive(spark, str(tmp_path / f"{i}"), text("u", f"2024-01-30 {at}", extra, i))
        folders.delete(spark, f"{root}/checkpoints/{kind}")
        play(spark, str(tmp_path / f"{i}"), root, kind)
    hot = hot_store.read_hot(spark, f"{root}/hot_events")
    row = hot.first()
    assert (row.country, row.client_id, row.cell_id, row.topic_id, row.install_campaign_app_id) == ("IN", "c2", "7", "t", "a2")
    assert row.pubname is None and (row.has_request, row.has_click, row.has_impression) == (1, 1, 1)
    assert set(mapped_targets()) <= set(hot.columns) and len(mapped_targets()) == 53
    cold.sink_day(hot, AS_OF, f"{root}/cold")
    assert cold.read_cold(spark, f"{root}/cold", hot.schema).first().country == "IN"
    flags = hot.select("unique_id", "has_click")._jdf.queryExecution().executedPlan().toString()
    assert "details" not in flags.split("FileScan")[1].split("ReadSchema")[1]


def test_ranges_in_one_part_are_read_without_a_merge(spark, feed, whole, rows, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    hot = f"{root}/hot_events"
    feed.drop("event_date").repartition(3).write.parquet(src)
    play(spark, src, root, cfg=replace(OPEN, max_files_per_trigger=1))

    def exchanges():
        return hot_store.read_hot(spark, hot)._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges() > 0
    hot_store.fold(spark, hot, 2)
    assert exchanges() == 0
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole
    late = feed.where("event_date = '2024-01-03'").drop("event_date")
    late.write.parquet(str(tmp_path / "late"))
    folders.delete(spark, f"{root}/checkpoints/request")
    play(spark, str(tmp_path / "late"), root)
    assert exchanges() > 0
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole


def test_the_chain_folds_sinks_and_drops_a_streamed_day(spark, feed, whole, tmp_path):
    from emberline.plans import chain

    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    hot = f"{root}/hot_events"
    feed.drop("event_date").repartition(3).write.parquet(src)
    play(spark, src, root, cfg=replace(OPEN, max_files_per_trigger=1))
    cfg = replace(OPEN, fold_after_parts=2)
    report = chain.daily_chain(hot_store.read_hot(spark, hot), str(tmp_path / "cold"), dt.date(2024, 1, 11), cfg, hot_dir=hot)
    assert {r.stage: r.status for r in report.collect()} == dict.fromkeys(["sink", "view", "reconcile", "drop"], "ok")
    left = hot_store.read_hot(spark, hot)
    assert left.where("event_day = 4").count() == 0 and left.count() == len([r for r in whole if r[ROW.index("event_day")] != 4])


def test_interaction_days_fold_once_and_survive_a_cut(spark, tmp_path, monkeypatch):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    table, number = f"{root}/interactions", 0
    for day in ("26", "27", "26", "27", "30"):
        number += 2
        arrive(spark, src, text("a", f"2024-01-{day} 10:00:00", number=number), text("a", f"2024-01-{day} 10:00:00", number=number + 1))
        play(spark, src, root, "generic_interaction")

    def ids():
        return sorted(r.event_id for r in interactions.read_interactions(spark, table).collect())

    whole = list(range(2, 12))
    assert ids() == whole
    monkeypatch.setattr(interactions.folders, "delete", lambda *a: False)
    interactions.fold_days(spark, table, dt.date(2024, 1, 28))
    monkeypatch.undo()
    assert ids() == whole
    interactions.fold_days(spark, table, dt.date(2024, 1, 28))
    assert ids() == whole
    assert interactions.fold_days(spark, table, dt.date(2024, 1, 28)) == []
    assert len(folders.partition_dirs(spark, table, ["part", *interactions.DAY_PARTS])) == 1
    # A batch that was folded runs again.
    folders.move(spark, f"{root}/checkpoints", str(tmp_path / "old"))
    play(spark, src, root, "generic_interaction")
    folded = [r for r in ids() if r < 10]
    assert folded == whole[:8]


def test_a_part_that_lands_while_a_table_is_read_is_not_seen(spark, feed, whole, rows, tmp_path, monkeypatch):
    """Listing and reading are one: what lands between them waits for the next read."""
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    hot = f"{root}/hot_events"
    feed.drop("event_date").write.parquet(src)
    play(spark, src, root)
    late = given.ad_events_raw(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).where("event_date = '2024-01-03'")

    def landing(spark_, path, levels, found=folders.partition_dirs):
        out = found(spark_, path, levels)
        hot_store.upsert(late, 77, hot, "late")
        return out

    monkeypatch.setattr(folders, "partition_dirs", landing)
    read = hot_store.read_hot(spark, hot)
    monkeypatch.undo()
    assert rows(read.select(*ROW)) == whole
    assert rows(hot_store.read_hot(spark, hot).select(*ROW)) == whole


def test_tasks_of_a_stream_take_small_splits(spark, tmp_path, monkeypatch):
    src, root, seen = str(tmp_path / "src"), str(tmp_path / "t"), []
    arrive(spark, src, text("a"))
    name, save = "spark.sql.files.maxPartitionBytes", run.upsert
    before = spark.conf.get(name)
    monkeypatch.setattr(run, "upsert", lambda batch, *rest: seen.append(batch.sparkSession.conf.get(name)) or save(batch, *rest))
    run.run_stream(spark, "vast", src, root, lambda: AS_OF, OPEN, once=True).awaitTermination()
    assert seen == ["8m"] and spark.conf.get(name) == before


def test_a_feed_with_every_field_is_written_in_files_of_few_rows(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "FILE_ROWS", 100)
    monkeypatch.setattr(checks.folders, "workspace", lambda spark, name: str(tmp_path / name))
    n = checks.hot_mapped_fields(spark, sf).count()
    ws = str(tmp_path / "hot_mapped_fields")
    held = spark.read.parquet(f"{ws}/feed").groupBy(F.input_file_name()).count().collect()
    runs = metrics.read_batches(spark, f"{ws}/tables/batch_metrics").collect()
    assert n and max(x["count"] for x in held) <= 110 and len(held) > 3 and len(runs) == 3
    assert sum(x.input_rows for x in runs) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_messages_with_every_field_are_not_dealt_out(spark, sf, tmp_path, monkeypatch):
    """Dealing rows sorts all that a task has read; messages are made after it."""
    frame, dealt = type(spark.range(0)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *args: dealt.append(self.columns) or deal(self, *args))
    monkeypatch.setattr(checks.folders, "workspace", lambda spark, name: str(tmp_path / name))
    checks.hot_mapped_fields(spark, sf)
    assert len(dealt) == 1 and "event_id" in dealt[0] and "payload" not in dealt[0] and len(dealt[0]) < 10
    assert spark.read.parquet(f"{tmp_path}/hot_mapped_fields/feed").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_cached_batches_of_a_stream_have_small_blocks(spark, tmp_path, monkeypatch):
    src, root, seen = str(tmp_path / "src"), str(tmp_path / "t"), []
    arrive(spark, src, text("a"))
    name, save = "spark.sql.inMemoryColumnarStorage.batchSize", run.upsert
    before = spark.conf.get(name)
    monkeypatch.setattr(run, "upsert", lambda batch, *rest: seen.append(batch.sparkSession.conf.get(name)) or save(batch, *rest))
    run.run_stream(spark, "click", src, root, lambda: AS_OF, OPEN, once=True).awaitTermination()
    assert seen == ["1000"] and spark.conf.get(name) == before
