"""The message log: offsets, limits per batch, restarts; what batches count of themselves."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from emberline.sources import folders, log, registry
from emberline.sources.log import Topic, allotted
from emberline.streaming import hot as hot_store
from emberline.streaming import metrics, run
from fixtures import inputs as given
from fixtures.checks import OPEN
from fixtures.inputs import AS_OF, ROW
from tests.test_streaming import arrive, text


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    import __spark_entry__ as entry

    spark.sparkContext.environment.setdefault("PYTHONPATH", entry.ROOT)


@pytest.fixture
def few(monkeypatch):
    """The registry, with 30 records a batch for clicks."""
    limited = tuple(replace(s, max_records=30) if s.kind == "click" else s for s in registry.STREAMS)
    monkeypatch.setattr(registry, "STREAMS", limited)


def messages(spark, lo, hi):
    return spark.createDataFrame([(i, text(f"u{i}", number=i)) for i in range(lo, hi)], "event_id bigint, payload string")


def batches(spark, root):
    return {x.batch_id: x.input_rows for x in metrics.read_batches(spark, f"{root}/batch_metrics").collect()}


def keys(spark, root):
    return sorted(x.event_id for x in hot_store.read_hot(spark, f"{root}/hot_events").select(F.expr("cast(substr(unique_id, 2) as int) AS event_id")).collect())


def test_shares_are_exact():
    assert allotted({"a": 5, "b": 7}, 20) == {"a": 5, "b": 7}
    for waiting, limit in (({"a": 10, "b": 20, "c": 0}, 7), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 10**12, "b": 1}, 10)):
        got = allotted(waiting, limit)
        assert sum(got.values()) == limit and all(got[k] <= waiting[k] for k in got)


def test_batches_keep_the_limit_and_a_restart_goes_on(spark, tmp_path, few):
    topic, root = Topic(str(tmp_path / "topic")), str(tmp_path / "t")
    log.append_log(messages(spark, 0, 100), topic.path, 3, 8)
    for n in (1, 2):
        run.run_stream(spark, "click", topic, root, lambda: AS_OF, OPEN, once=True).awaitTermination()
        assert batches(spark, root) == {i: 30 for i in range(n)}
    assert len(keys(spark, root)) == 60
    log.append_log(messages(spark, 100, 110), topic.path, 3, 8)
    assert run.drain(spark, "click", topic, root, lambda: AS_OF, OPEN) == 2
    assert batches(spark, root) == {0: 30, 1: 30, 2: 30, 3: 20}
    assert keys(spark, root) == list(range(110))
    assert run.drain(spark, "click", topic, root, lambda: AS_OF, OPEN) == 0


def test_a_failed_batch_runs_again_over_the_same_records(spark, tmp_path, few, monkeypatch):
    topic, root = Topic(str(tmp_path / "topic")), str(tmp_path / "t")
    log.append_log(messages(spark, 0, 50), topic.path, 2, 100)

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(run, "save_batch", fail)
    with pytest.raises(Exception, match="lost"):
        run.run_stream(spark, "click", topic, root, lambda: AS_OF, OPEN, once=True).awaitTermination()
    monkeypatch.undo()
    limited = tuple(replace(s, max_records=30) if s.kind == "click" else s for s in registry.STREAMS)
    monkeypatch.setattr(registry, "STREAMS", limited)
    log.append_log(messages(spark, 50, 60), topic.path, 2, 100)
    run.drain(spark, "click", topic, root, lambda: AS_OF, OPEN)
    assert batches(spark, root) == {0: 30, 1: 30} and keys(spark, root) == list(range(60))


def test_starting_offsets(spark, tmp_path):
    path = str(tmp_path / "topic")
    log.append_log(messages(spark, 0, 40), path, 2, 10)
    ends = log.Segments(path).ends()
    for starting, want in (("latest", 0), ({"0": ends["0"] - 3, "1": ends["1"]}, 3), ("earliest", 40)):
        root = str(tmp_path / f"t{want}")
        run.drain(spark, "click", Topic(path, starting), root, lambda: AS_OF, OPEN)
        assert sum(batches(spark, root).values()) == want


def test_a_gap_in_the_segments_ends_what_is_read(spark, tmp_path):
    path = str(tmp_path / "topic")
    log.append_log(messages(spark, 0, 40), path, 1, 10)
    folders.delete(spark, f"{path}/log_partition=0/base=20")
    assert log.Segments(path).ends() == {"0": 20}


def test_offsets_are_dense(spark, tmp_path):
    path = str(tmp_path / "topic")
    for lo in (0, 25):
        log.append_log(messages(spark, lo, lo + 25), path, 3, 4)
    got = spark.read.parquet(path).groupBy("log_partition").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.max("offset").alias("m"))
    assert all(x.n == x.d == x.m + 1 for x in got.collect()) and spark.read.parquet(path).count() == 50


def test_a_batch_counts_itself_in_the_write(spark, tmp_path):
    """The metrics of a batch without quarantine run no job beside the write."""
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    late = text("l").replace("2024-01-30", "2023-01-30")
    arrive(spark, src, "{bad", late, text("a"), text("b", "2024-01-30 11:00:00"))
    judged = run.judge(spark.read.parquet(src), "vast", AS_OF, OPEN)
    watched, seen = metrics.observed(judged)
    spark.sparkContext.setJobGroup("one", "one")
    watched.where("reason is null").write.parquet(str(tmp_path / "kept"))
    counts = metrics.counts_of(seen)
    metrics.save_batch(spark, f"{root}/batch_metrics", "vast", "r", 0, counts)
    group = spark.sparkContext.statusTracker().getJobIdsForGroup("one")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(group) == 1
    row = metrics.read_batches(spark, f"{root}/batch_metrics").first()
    assert (row.input_rows, row.kept_rows, row.unparseable, row.too_late, row.null_users) == (4, 2, 1, 1, 1)
    assert row.last_ts == "2024-01-30 11:00:00" and row.app == "vast"


def test_an_empty_batch_has_counts(spark, tmp_path):
    judged = run.judge(spark.createDataFrame([], "event_id bigint, payload string"), "click", AS_OF, OPEN)
    watched, seen = metrics.observed(judged)
    hot_store.upsert(watched.where("reason is null"), 0, str(tmp_path / "hot"))
    assert metrics.counts_of(seen)["input_rows"] == 0


def test_replayed_events_are_left_out_after_a_restart(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    run.state_in_rocksdb(spark)
    try:
        for ids in ([1, 2, 2], [2, 3], [1, 4, 4]):
            rows = [(i, dt.datetime(2024, 1, 30, 10, i), 1, "view") for i in ids]
            made = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string")
            made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(src)
            stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").parquet(src)
            run.append_interactions(stream, out, mark, once=True, within="2 days").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(x.event_id for x in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_hourly_and_daily_windows_of_one_stream_are_final(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "ts timestamp_ntz, event_type string"

    def feed_and_run(*times):
        made = spark.createDataFrame([(dt.datetime.fromisoformat(t), "click") for t in times], "ts timestamp, event_type string")
        made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(src)
        for i, name in enumerate(("hours", "days")):
            counts = run.rollup(spark.readStream.schema(schema).parquet(src), "2 days")[i]
            run.run_rollup(counts, str(tmp_path / name), str(tmp_path / f"{name}-mark"), once=True).awaitTermination()

    feed_and_run("2024-01-10 01:10:00", "2024-01-10 01:20:00", "2024-01-10 05:00:00")
    feed_and_run("2024-01-10 01:59:59", "2024-01-11 03:00:00")
    feed_and_run("2024-02-01 00:00:00")
    hours = {(x.window_start.day, x.window_start.hour): x.rows for x in spark.read.parquet(str(tmp_path / "hours")).collect()}
    days = {x.event_date.day: (x.rows, x.busiest) for x in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert hours == {(10, 1): 3, (10, 5): 1, (11, 3): 1} and days == {10: (4, 3), 11: (1, 1)}


def test_the_log_feeds_the_hot_table(spark, sf, tmp_path, rows):
    topic, root = Topic(str(tmp_path / "topic")), str(tmp_path / "t")
    log.append_log(given.messages(spark, sf), topic.path, 4, 300)
    run.drain(spark, "request", topic, root, lambda: AS_OF, OPEN)
    assert rows(hot_store.read_hot(spark, f"{root}/hot_events").select(*ROW)) == rows(given.ad_events(spark, sf).select(*ROW))


def test_a_long_log_is_not_listed_for_every_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "topic")
    log.append_log(messages(spark, 0, 300), path, 3, 10)
    listed, found = [], log.Segments.found
    monkeypatch.setattr(log.Segments, "found", lambda self: listed.append(1) or found(self))
    reader = log.LogReader({"path": path, "maxRecords": "20"})
    start, taken = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        taken.append(sum(s.hi - s.lo for s in reader.partitions(start, end)))
        start = end
    assert taken == [20] * 15 and len(listed) <= 3


def test_drain_is_one_query(spark, tmp_path, few, monkeypatch):
    topic, root, started = Topic(str(tmp_path / "topic")), str(tmp_path / "t"), []
    log.append_log(messages(spark, 0, 100), topic.path, 3, 8)
    start = run.run_stream
    monkeypatch.setattr(run, "run_stream", lambda *args, **more: started.append(1) or start(*args, **more))
    assert run.drain(spark, "click", topic, root, lambda: AS_OF, OPEN) == 4 and started == [1]
    assert batches(spark, root) == {0: 30, 1: 30, 2: 30, 3: 10}


def test_a_small_batch_is_one_task_without_a_shuffle(spark, tmp_path, few, monkeypatch):
    topic, root, plans = Topic(str(tmp_path / "topic")), str(tmp_path / "t"), []
    log.append_log(messages(spark, 0, 70), topic.path, 3, 8)
    write = hot_store.write_part
    monkeypatch.setattr(hot_store, "write_part", lambda states, path, few: plans.append((few, states._jdf.queryExecution().executedPlan().toString())) or write(states, path, few))
    assert run.drain(spark, "click", topic, root, lambda: AS_OF, OPEN) == 3
    assert len(plans) == 3 and all(whole and "Exchange" not in plan for whole, plan in plans)
    assert batches(spark, root) == {0: 30, 1: 30, 2: 10} and keys(spark, root) == list(range(70))


def test_one_task_reads_the_slices_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "topic")
    log.append_log(messages(spark, 0, 50), path, 3, 4)
    reader = log.LogReader({"path": path, "maxRecords": "20", "oneTask": "true"})
    start, got = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        (whole,) = reader.partitions(start, end)
        got.append(sorted(x for b in reader.read(whole) for x in b.column("event_id").to_pylist()))
        start = end
    assert [len(x) for x in got] == [20, 20, 10] and sorted(sum(got, [])) == list(range(50))
    assert reader.partitions(start, start) == []


def test_the_last_time_of_a_batch_has_six_digits(spark, tmp_path):
    """As its SQL has it, also where the last digits are zeros."""
    src, made = str(tmp_path / "src"), {}
    for at in ("2024-01-30 11:00:00.393990", "2024-01-30 11:00:00"):
        arrive(spark, f"{src}{len(made)}", text("a", at))
        watched, seen = metrics.observed(run.judge(spark.read.parquet(f"{src}{len(made)}"), "vast", AS_OF, OPEN))
        watched.write.parquet(f"{src}-{len(made)}")
        made[at] = metrics.counts_of(seen)["last_ts"]
    assert all(got == at for at, got in made.items())
