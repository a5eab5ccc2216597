"""Partition plans and the functions that change folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from emberline import Settings
from emberline.functions.calendar import day_calendar
from emberline.functions.columns import partition_last
from emberline.operators import filters
from emberline.plans import chain, lifecycle, profile, views
from emberline.schema import PARTS
from emberline.sources import cold, folders, sync, users
from emberline.streaming import hot as hot_store
from fixtures import inputs as given
from fixtures.inputs import AS_OF, D7, D15, ROW


@pytest.fixture(scope="module")
def merged(spark, sf):
    return partition_last(given.ad_events(spark, sf).select(*ROW)).cache()


def store(df, path, fmt="orc"):
    cold.write_partitions(df, path, PARTS, fmt)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def test_half_day_ranges_tile(spark, rows):
    df = spark.createDataFrame([(dt.date(2023, 12, 29),), (dt.date(2024, 2, 27),)], "as_of date")
    assert rows(lifecycle.range_plan(df)) == [
        (dt.date(2023, 12, 31), 0, dt.date(2023, 12, 31), 12),
        (dt.date(2023, 12, 31), 12, dt.date(2024, 1, 1), 0),
        (dt.date(2024, 2, 29), 0, dt.date(2024, 2, 29), 12),
        (dt.date(2024, 2, 29), 12, dt.date(2024, 3, 1), 0),
    ]
    assert lifecycle.range_plan(df, step_hours=24).count() == 2


def test_assign_range_edges(spark):
    ranges = lifecycle.ranges_of(day_calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 1)), 12)
    df = spark.createDataFrame(
        [(2024, 1, 1, h) for h in (0, 11, 12, 23)] + [(2024, 1, 2, 0)],
        "event_year int, event_month int, event_day int, event_hour int",
    )
    got = {(r.event_day, r.event_hour): (r.lower_hour, r.covered) for r in lifecycle.assign_range(df, ranges).collect()}
    assert got == {(1, 0): (0, True), (1, 11): (0, True), (1, 12): (12, True), (1, 23): (12, True), (2, 0): (None, False)}


def test_drop_plan_holds_with_reason_and_drops(spark, sf, tmp_path):
    hot, lossy = given.classified(spark, sf), given.cold_defect(spark, sf)
    held = lifecycle.drop_plan(hot, lossy, dt.date(2024, 1, 28)).collect()
    assert {r.action for r in held} == {"hold"} and {str(r.lower_date) for r in held} == {"2024-01-21"}
    assert all("hot rows" in r.reason and "percent" in r.reason for r in held)
    plan = lifecycle.drop_plan(hot, lossy, dt.date(2024, 1, 31))
    assert [(r.action, r.reason) for r in plan.collect()] == [("drop", None)] * 2

    path = str(tmp_path / "hot")
    stored = store(partition_last(hot.select(*ROW)), path, "parquet")
    before, day = stored.count(), filters.slice_(stored, 2024, 1, 24).count()
    gone = lifecycle.apply_drop(spark, plan, path, hot, str(tmp_path / "residue"))
    assert gone and not [g for g in gone if "event_day=24" not in g]
    assert day and spark.read.parquet(path).count() == before - day

    made = str(tmp_path / "parts")
    events = given.ad_events_raw(spark, sf)
    hot_store.upsert(events.where("event_date between '2024-01-24' and '2024-01-25'"), 0, made)
    hot_store.upsert(events.where("event_date = '2024-01-24'"), 1, made)
    lifecycle.apply_drop(spark, plan, made, hot, str(tmp_path / "residue"))
    assert folders.children(spark, made) == ["part=batch-0000000000"]
    kept = hot_store.read_hot(spark, made).select("event_day").distinct().collect()
    assert [r.event_day for r in kept] == [25]


def test_drop_plan_of_an_empty_day_passes(spark, sf):
    hot = given.classified(spark, sf)
    assert {r.action for r in lifecycle.drop_plan(hot, hot, dt.date(2025, 1, 1)).collect()} == {"drop"}


def test_compaction_keeps_clicks_of_that_day_only(spark, merged, tmp_path):
    path = str(tmp_path / "fill")
    rows = filters.fill(merged)
    stored = store(rows, path)
    want = rows.where((F.make_date("event_year", "event_month", "event_day") != F.lit(D15)) | (F.col("has_click") == 1)).count()
    for _ in range(2):
        lifecycle.compact_clicks(spark.read.schema(rows.schema).orc(path), D15, path)
        assert spark.read.schema(rows.schema).orc(path).count() == want
    assert not [name for name in os.listdir(path) if "staging" in name]
    assert stored.columns == rows.columns


def test_compaction_of_a_day_without_clicks_removes_it(spark, merged, tmp_path):
    path = str(tmp_path / "fill")
    rows = filters.fill(merged).withColumn("has_click", F.lit(None).cast("int"))
    store(rows, path)
    lifecycle.compact_clicks(spark.read.schema(rows.schema).orc(path), D15, path)
    assert filters.slice_(spark.read.schema(rows.schema).orc(path), 2024, 1, 15).count() == 0
    assert not os.path.exists(f"{path}/{folders.day_dir(D15)}")


def test_nofill_month_goes_at_its_last_day(spark, merged, tmp_path):
    path = str(tmp_path / "nofill")
    rows = filters.nofill(merged)
    store(rows, path)
    early = lifecycle.nofill_plan(rows, dt.date(2024, 2, 14))
    assert early.where("level = 'month'").count() == 0
    plan = lifecycle.nofill_plan(rows, dt.date(2024, 2, 15))
    assert [(r.year, r.month, r.day) for r in plan.where("level = 'month'").collect()] == [(2024, 1, None)]
    lifecycle.apply_nofill_plan(spark, plan, path)
    assert not os.path.exists(f"{path}/event_year=2024/event_month=1")


def test_reset_then_sink_again(spark, merged, tmp_path, rows):
    root = str(tmp_path / "cold")
    cold.sink_day(merged, D7, root)
    first = rows(cold.read_cold(spark, root, merged.schema))
    for cls in ("fill", "nofill"):
        status = lifecycle.reset_day(spark, cold.table_dir(root, cls), D7)
        assert status.count() == 24
    assert {r.status for r in lifecycle.reset_day(spark, cold.table_dir(root, "fill"), D7).collect()} == {"absent"}
    cold.sink_day(merged, D7, root)
    assert rows(cold.read_cold(spark, root, merged.schema)) == first


def test_sink_again_changes_nothing(spark, merged, tmp_path, rows):
    root = str(tmp_path / "cold")
    cold.sink_hour(merged, 2024, 1, 23, 10, root)
    cold.sink_day(merged, D7, root, 11, 23)
    once = rows(cold.read_cold(spark, root, merged.schema))
    cold.sink_day(merged, D7, root, 11, 23)
    cold.sink_hour(merged, 2024, 1, 23, 10, root)
    assert rows(cold.read_cold(spark, root, merged.schema)) == once
    hours = {r.event_hour for r in cold.read_cold(spark, root, merged.schema).collect()}
    assert hours and min(hours) >= 10


def test_views_are_disjoint_and_whole(spark, sf):
    hot, c = given.hot_events(spark, sf).select(*ROW), given.cold_events(spark, sf)
    view = views.tier_view(hot, c, AS_OF)
    assert view.count() == view.select("unique_id").distinct().count()
    assert view.columns[-4:] == PARTS
    assert views.overlap_audit(hot, c).count() == 1


def test_sync_reaches_a_fixed_point(spark, merged, tmp_path):
    src = filters.fill(merged)
    path = str(tmp_path / "copy")
    lossy = src.where(~((F.col("event_day") % 5 == 0) | ((F.col("event_day") == 7) & (F.col("user_id") % 2 == 0))))
    changed = lossy.withColumn("zone", F.when(F.col("event_day") == 9, "other").otherwise(F.col("zone")))
    extra = changed.where("event_day = 11").withColumn("event_hour", F.lit(1)).withColumn("unique_id", F.lit("stale"))
    dst = store(changed.unionByName(extra.select(*changed.columns)), path)
    plan = sync.sync_plan(src, dst)
    got = {r.event_date.day: r.action for r in plan.collect()}
    assert got[5] == "copy" and got[7] == "update" and got[9] == "update" and got[11] == "update" and got[8] == "skip"
    done = sync.sync_apply(plan, src, path)
    assert {d.day for d in done} == {d for d, a in got.items() if a != "skip"}
    again = sync.sync_plan(src, spark.read.schema(src.schema).orc(path))
    assert {r.action for r in again.collect()} == {"skip"}
    assert sync.sync_apply(again, src, path) == []


def test_discovery_sees_added_and_removed(spark, merged, tmp_path):
    path = str(tmp_path / "t")
    rows = filters.fill(merged).where("event_day <= 3")
    store(rows, path)
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark.sql(f"CREATE TABLE found_parts ({cols}) USING orc PARTITIONED BY ({', '.join(PARTS)}) LOCATION '{path}'")
    try:
        assert {r.status for r in lifecycle.discover(spark, "found_parts").collect()} == {"added"}
        folders.delete(spark, f"{path}/event_year=2024/event_month=1/event_day=2")
        got = {r.status for r in lifecycle.discover(spark, "found_parts").collect()}
        assert got == {"present", "removed"}
        assert spark.table("found_parts").where("event_day = 2").count() == 0
    finally:
        spark.sql("DROP TABLE found_parts")


def test_chain_stops_at_the_first_failure(spark, merged, tmp_path):
    def lossy_sink(hot, date, root):
        cold.sink_day(hot.where(F.col("user_id") % 2 == 0), date, root)

    def broken_sink(hot, date, root):
        raise OSError("disk")

    hot = filters.window_(merged, dt.date(2024, 1, 22))
    got = {r.stage: r.status for r in chain.daily_chain(hot, str(tmp_path / "a"), AS_OF, sink=lossy_sink).collect()}
    assert got == {"sink": "ok", "view": "ok", "reconcile": "failed", "drop": "skipped"}
    got = {r.stage: r.status for r in chain.daily_chain(hot, str(tmp_path / "b"), AS_OF, sink=broken_sink).collect()}
    assert got["sink"].startswith("failed: OSError: ") and got["drop"] == "skipped"


def test_tier_plan_covers_every_age(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 14), dt.date(2024, 2, 2))], "lo date, hi date")
    got = {}
    for r in lifecycle.tier_plan(bounds, AS_OF).collect():
        got.setdefault(r.age_days, set()).add(r.action)
    assert got[-3] == {"none"} and got[-2] == {"create"} and got[6] == {"hot"}
    assert got[7] == {"sink", "drop_hot"} and got[8] == {"cold"}
    assert got[15] == {"compact", "delete_nofill"} and got[16] == {"clicks_only"}


def test_backfill_equals_hot_profile(spark, sf):
    c = given.cold_events(spark, sf)
    zones = [f"zone_{i}" for i in range(9)]
    hot = filters.fill(given.ad_events(spark, sf))
    for hour in (3, 10, 17):
        a = sorted(map(tuple, profile.profile_hour(hot, 2024, 1, 23, hour, zones).collect()))
        b = sorted(map(tuple, profile.profile_backfill(c, 2024, 1, 23, hour, zones).collect()))
        assert a == b


def test_profile_weeks_do_not_meet_across_years(spark):
    df = spark.createDataFrame(
        [(2023, 3, 21, 1, 9, "z", 2, 1), (2024, 3, 21, 1, 9, "z", 0, 1)],
        "event_year int, event_month int, event_day int, event_hour int, user_id bigint, zone string, impressions bigint, clicks bigint",
    )
    got = {r.profile_year: r.ctr for r in profile.profile_week(df).collect()}
    assert got == {2023: 0.5, 2024: None}


def test_saving_a_week_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "weeks")
    names = "profile_year int, week_number int, user_id bigint, impressions bigint"
    profile.save_week(spark.createDataFrame([(2024, 3, 1, 1), (2024, 4, 1, 1)], names), path)
    profile.save_week(spark.createDataFrame([(2024, 4, 1, 5)], names), path)
    got = {r.week_number: r.impressions for r in spark.read.parquet(path).collect()}
    assert got == {3: 1, 4: 5}


def test_increment_rerun_replaces(spark, sf, tmp_path):
    path = str(tmp_path / "inc")
    one = profile.profile_hour(given.ad_events(spark, sf), 2024, 1, 29, 1, [f"zone_{i}" for i in range(9)])
    for _ in range(2):
        profile.save_increment(one, path, 2024, 1, 29, 1)
        assert spark.read.schema(one.schema).parquet(path).count() == one.count() > 0
    profile.save_increment(one.where("false"), path, 2024, 1, 29, 1)
    assert spark.read.schema(one.schema).parquet(path).count() == 0


def test_ledger_rows_cross_year_and_reprocess(spark, tmp_path):
    hours = spark.createDataFrame([(dt.datetime(2023, 12, 31, 23),)], "hour_ts timestamp").select(F.col("hour_ts").cast("timestamp_ntz"))
    row = profile.ledger_rows(hours, "job").first()
    assert (row.next_year, row.next_month, row.next_day, row.next_hour) == (2024, 1, 1, 0)
    assert (row.week_number, row.is_processed, row.retries) == (53, 0, 1)
    path = str(tmp_path / "ledger")
    profile.append_ledger(profile.ledger_rows(hours, "job"), path)
    assert spark.read.parquet(path).count() == 1


def test_retry_cap(spark):
    names = "job_name string, current_year int, current_month int, current_day int, current_hour int, is_processed int, retries int"
    led = spark.createDataFrame([("j", 2024, 1, 1, 0, 0, 9), ("j", 2024, 1, 1, 1, 0, 10), ("j", 2024, 1, 1, 2, 1, 1), ("j", 2024, 1, 1, 4, 1, 1)], names)
    day = dt.date(2024, 1, 1)
    gate = spark.createDataFrame(
        [(day, 2, False), (day, 3, True), (day, 4, True)], "event_date date, event_hour int, passed boolean"
    )
    got = {(r.event_hour, r.retries, r.reason) for r in profile.reprocess_plan(led, "j", gate).collect()}
    assert got == {(0, 10, "unprocessed"), (2, 2, "count_mismatch"), (3, 1, "never_recorded")}
    open_ = {r.event_hour: r.retries for r in profile.unprocessed(led, "j", day, day).collect()}
    assert open_[0] == 9 and 1 not in open_ and 2 not in open_ and open_[3] == 0 and len(open_) == 21


def test_change_gate_is_inclusive(spark):
    def hour(n):
        return spark.range(n).selectExpr("2024 AS event_year", "1 AS event_month", "1 AS event_day", "5 AS event_hour")

    got = profile.change_gate(hour(100), hour(95)).first()
    assert (got.pct_diff, got.passed) == (-5.0, True)
    assert profile.change_gate(hour(100), hour(94)).first().passed is False


def test_users_load_is_latest_and_replaces(spark, sf, tmp_path):
    path = str(tmp_path / "users")
    loaded = users.load_users(given.user_documents(spark, sf), AS_OF)
    assert loaded.count() == given.users(spark, sf).count()
    for _ in range(2):
        users.save_users(loaded, path)
    assert spark.read.parquet(path).count() == loaded.count()
    assert Settings().hot_days == 7


def test_rows_of_no_class_hold_a_date_that_has_nothing_else(spark, sf):
    rows = given.classified(spark, sf).where("event_date = '2024-01-20'")
    lost = rows.withColumn("event_class", F.lit("unclassified"))
    plan = lifecycle.drop_plan(lost, rows.where("false"), dt.date(2024, 1, 27)).collect()
    assert {(r.action, r.residue) for r in plan} == {("hold", rows.count())}
    assert all("no class" in r.reason for r in plan)
    both = rows.union(lost.limit(3).select(*rows.columns))
    plan = lifecycle.drop_plan(both, rows.where("event_class <> 'unclassified'"), dt.date(2024, 1, 27)).collect()
    assert {(r.action, r.residue) for r in plan} == {("drop", 3 + rows.where("event_class = 'unclassified'").count())}


def test_jobs_do_not_close_each_others_hours(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    hours = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in range(24)], "hour_ts timestamp").select(F.col("hour_ts").cast("timestamp_ntz").alias("hour_ts"))
    path = str(tmp_path / "ledger")
    for job in ("a", "b"):
        profile.append_ledger(profile.ledger_rows(hours, job), path)
    profile.append_ledger(profile.close_hours(hours, "b", True, 1), path)
    profile.append_ledger(profile.close_hours(hours.where(F.hour("hour_ts") == 3), "a", False, 1), path)
    ledger = profile.read_ledger(spark, path)
    assert profile.unprocessed(ledger, "b", day, day).count() == 0
    assert {r.event_hour: r.retries for r in profile.unprocessed(ledger, "a", day, day).collect()} == {h: 1 + (h == 3) for h in range(24)}


def test_a_rerun_of_the_sink_leaves_no_stale_class(spark, sf, tmp_path):
    """A late click turns nofill rows of an hour into fill rows."""
    root, day = str(tmp_path / "cold"), dt.date(2024, 1, 20)
    hot = partition_last(given.ad_events(spark, sf)).where("event_month = 1 AND event_day = 20")
    cold.sink_day(hot, day, root)
    before = cold.read_cold(spark, root, hot.schema)
    assert before.where("event_class = 'nofill'").count() > 0
    clicked = hot.withColumn("has_click", F.lit(1))
    cold.sink_day(clicked, day, root)
    after = cold.read_cold(spark, root, hot.schema)
    assert after.where("event_class = 'nofill'").count() == 0
    assert after.count() == hot.count() == after.select("unique_id").distinct().count()
    cold.sink_hour(clicked.where("false"), 2024, 1, 20, 5, root)
    assert cold.read_cold(spark, root, hot.schema).where("event_hour = 5").count() == 0


def test_a_replacement_cut_short_is_finished_by_the_next(spark, sf, tmp_path, monkeypatch):
    """The rows are written, the emptied hours are not deleted yet."""
    table, rows = str(tmp_path / "t"), partition_last(given.ad_events(spark, sf))
    cold.migrate_days(rows, dt.date(2024, 1, 21), 1, table)
    fewer = rows.where("event_hour >= 12")

    def lost(*args):
        raise OSError("lost")

    monkeypatch.setattr(folders, "delete_partitions", lost)
    with pytest.raises(OSError):
        cold.migrate_days(fewer, dt.date(2024, 1, 21), 1, table)
    monkeypatch.undo()
    cold.migrate_days(fewer, dt.date(2024, 1, 21), 1, table)
    hours = {r.event_hour for r in spark.read.schema(rows.schema).parquet(table).collect()}
    assert hours and min(hours) >= 12
    cold.migrate_days(fewer.where("false"), dt.date(2024, 1, 21), 1, table)
    assert folders.partition_dirs(spark, table, ["event_year"]) == []


def test_only_partitions_in_scope_go(spark, sf, tmp_path):
    root, rows = str(tmp_path / "cold"), partition_last(given.ad_events(spark, sf))
    for day in (20, 21):
        cold.sink_day(rows, dt.date(2024, 1, day), root)
    before = cold.read_cold(spark, root, rows.schema).where("event_day = 21 OR event_hour <> 7").count()
    cold.sink_hour(rows.where("false"), 2024, 1, 20, 7, root)
    assert cold.read_cold(spark, root, rows.schema).count() == before


def register(spark, name, rows, path, fmt, columns):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark.sql(f"CREATE TABLE {name} ({cols}) USING {fmt} PARTITIONED BY ({', '.join(columns)}) LOCATION '{path}'")


def test_the_chain_switches_the_view_after_the_sink_only(spark, merged, tmp_path):
    hot_dir, cold_dir = str(tmp_path / "hot"), str(tmp_path / "cold")
    hot = store(filters.window_(merged, dt.date(2024, 1, 22)), hot_dir, "parquet")
    register(spark, "chain_hot", hot, hot_dir, "parquet", PARTS)
    register(spark, "chain_cold", hot.withColumn("event_class", F.lit("")), cold_dir, "orc", ["event_class", *PARTS])
    spark.sql("MSCK REPAIR TABLE chain_hot")
    view = chain.CatalogView("chain_view", "chain_hot", "chain_cold")

    def broken_sink(hot, date, root):
        raise OSError("disk")

    try:
        before = views.switch_view(spark, view.name, view.hot, view.cold, AS_OF - dt.timedelta(days=1))
        report = chain.daily_chain(hot, cold_dir, AS_OF, sink=broken_sink, hot_dir=hot_dir, view=view)
        assert [r.status for r in report.collect()][1:] == ["skipped"] * 3
        assert views.stored_text(spark, view.name) == before
        whole = spark.table(view.name).count()
        assert whole == filters.window_(merged, dt.date(2024, 1, 22), dt.date(2024, 1, 29)).count() and "2024-01-22" in before
        report = chain.daily_chain(hot, cold_dir, AS_OF, hot_dir=hot_dir, view=view)
        assert {r.status for r in report.collect()} == {"ok"}
        after = views.stored_text(spark, view.name)
        assert after != before and "2024-01-23" in after
        # The day was sunk and dropped; readers of the view find it all the same, once.
        day = filters.slice_(spark.table(view.name), D7.year, D7.month, D7.day)
        held = filters.classify(filters.slice_(merged, D7.year, D7.month, D7.day)).where("event_class <> 'unclassified'")
        assert day.count() == held.count() > 0
        assert spark.read.schema(hot.schema).parquet(hot_dir).where("event_day = 23").count() == 0
        lost = filters.slice_(merged, D7.year, D7.month, D7.day).count() - held.count()
        saved = spark.read.schema(hot.schema).parquet(f"{cold_dir}_residue").count() if os.path.exists(f"{cold_dir}_residue") else 0
        assert saved == lost
    finally:
        spark.sql("DROP VIEW IF EXISTS chain_view")
        for name in ("chain_hot", "chain_cold"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_residue_is_saved_or_holds_its_range(spark, sf, tmp_path):
    rows = given.classified(spark, sf).where("event_date = '2024-01-20'")
    some = rows.where("event_class <> 'unclassified'").limit(4)
    rows = rows.where("event_class <> 'unclassified'").join(some.select("unique_id"), "unique_id", "left_anti").select(*rows.columns).union(some.withColumn("event_class", F.lit("unclassified")))
    path = str(tmp_path / "hot")
    store(partition_last(rows.select(*ROW)), path, "parquet")
    plan = lifecycle.drop_plan(rows, rows.where("event_class <> 'unclassified'"), dt.date(2024, 1, 27))
    assert {(r.action, r.residue) for r in plan.collect()} == {("drop", 4)}
    assert lifecycle.apply_drop(spark, plan, path) == []
    assert lifecycle.apply_drop(spark, plan, path, rows, str(tmp_path / "residue"))
    assert spark.read.parquet(str(tmp_path / "residue")).count() == 4
    assert folders.partition_dirs(spark, path, ["event_year", "event_month", "event_day", "event_hour"]) == []


def scans(df):
    """Paths that a plan's scans are rooted at, and how many there are."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_rerun_takes_back_what_the_hour_had(spark, sf, tmp_path, rows):
    zones = [f"zone_{i}" for i in range(9)]
    hot = given.ad_events(spark, sf).where("event_day between 3 and 12")
    whole = profile.profile_hours(hot, zones).cache()
    hours = [dt.datetime(2024, 1, d, h) for d in range(3, 13) for h in range(24)]
    root = str(tmp_path / "p")

    def expected(increments):
        return rows(profile.profile_week(increments).select("profile_year", "week_number", "user_id", "zone", "impressions", "clicks"))

    def held(weeks=None):
        return rows(profile.read_weeks(spark, root, weeks).drop("ctr").select("profile_year", "week_number", "user_id", "zone", "impressions", "clicks"))

    lossy = whole.where("user_id % 3 <> 0")
    profile.apply_hours(lossy, hours, 1, root)
    assert held() == expected(lossy)
    some = [at for at in hours if at.day in (4, 11)]
    picked = whole.where("event_day in (4, 11)")
    for _ in range(2):  # the second run, as after a cut, changes nothing
        profile.apply_hours(picked, some, 2, root)
        mixed = lossy.where("event_day not in (4, 11)").unionByName(picked)
        assert held() == expected(mixed)
    profile.fold_weeks(spark, root, 2)
    assert held() == expected(mixed) and folders.children(spark, f"{root}/changes") == []
    # An hour that has nothing any more, then all again.
    gone = [at for at in hours if at.day == 11]
    profile.apply_hours(whole.where("false"), gone, 3, root)
    assert held() == expected(mixed.where("event_day <> 11"))
    assert held([(2024, 1)]) == expected(mixed.where("event_day between 7 and 12 and event_day <> 11"))
    profile.apply_hours(whole, hours, 4, root)
    assert held() == expected(whole)
    assert profile._latest(spark, f"{root}/increments", gone, 4) and all(p.startswith("version=3/") for p in profile._latest(spark, f"{root}/increments", gone, 4))


def test_prints_are_kept_and_only_differing_buckets_are_read(spark, merged, tmp_path):
    src = filters.fill(merged)
    stored = store(src, str(tmp_path / "src"))
    copy = store(src.where("NOT (event_day = 7 AND user_id % 5 = 0)").withColumn("zone", F.when(F.col("event_day") == 9, "other").otherwise(F.col("zone"))), str(tmp_path / "dst"))
    days = [dt.date(2024, 1, d) for d in range(1, 31)]
    for rows_, name in ((stored, "a"), (copy, "b")):
        sync.save_prints(rows_, days, str(tmp_path / name))
    a, b = (sync.read_prints(spark, str(tmp_path / name)) for name in "ab")
    plan = sync.prints_plan(a, b)
    text_ = scans(plan)
    assert str(tmp_path / "src") not in text_ and str(tmp_path / "dst") not in text_
    got = plan.collect()
    assert {r.event_date.day for r in got if r.action == "update"} == {7, 9} and {r.action for r in got} == {"update", "skip"}
    full = sync.sync_plan(src, copy)
    assert {(r.event_date, r.action) for r in full.collect()} == {(r.event_date, r.action) for r in got}
    differ = sync.differing_rows(plan, stored, copy)
    assert "event_day#" in scans(differ).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    found = {(r.event_date.day, r.status) for r in differ.collect()}
    assert found == {(7, "new"), (9, "changed")}
    # One day is mended; its prints alone are made again.
    sync.sync_apply(full.where("event_date = '2024-01-07'"), stored, str(tmp_path / "dst"))
    before = folders.files(spark, str(tmp_path / "b" / "event_date=2024-01-09"))
    mended = spark.read.schema(src.schema).orc(str(tmp_path / "dst"))
    sync.save_prints(mended, [dt.date(2024, 1, 7)], str(tmp_path / "b"))
    assert folders.files(spark, str(tmp_path / "b" / "event_date=2024-01-09")) == before
    again = sync.prints_plan(a, sync.read_prints(spark, str(tmp_path / "b"))).collect()
    assert {r.event_date.day for r in again if r.action == "update"} == {9}


def test_intervals_of_any_bounds(spark, rows):
    import random

    r = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    spans = [(i, base + dt.timedelta(minutes=r.randrange(40_000)), r.choice([0, 1, 30, 700, 15_000])) for i in range(60)]
    made = [(i, lo, lo + dt.timedelta(minutes=n)) for i, lo, n in spans] + [(90, base, None), (91, None, base)]
    intervals = spark.createDataFrame(made, "name int, lo timestamp, hi timestamp").selectExpr("name", "cast(lo as timestamp_ntz) lo", "cast(hi as timestamp_ntz) hi")
    points = [(i, base + dt.timedelta(seconds=r.randrange(2_700_000))) for i in range(300)] + [(500, spans[1][1]), (501, None), (501, None), (7, base), (7, base)]
    df = spark.createDataFrame(points, "id int, ts timestamp").selectExpr("id", "cast(ts as timestamp_ntz) ts")
    got = lifecycle.assign_interval(df, intervals, "ts", 60)
    plan = scans(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = []
    for i, ts in points:
        held = [(i, ts, name, lo, hi, True) for name, lo, hi in made if ts and lo and hi and lo <= ts < hi]
        want += held or [(i, ts, None, None, None, False)]
    assert rows(got) == sorted(want, key=repr)
    pairs = [(a[0], b[0], max(a[1], b[1]), min(a[2], b[2])) for a in made for b in made if a[0] < b[0] and None not in (*a, *b) and max(a[1], b[1]) < min(a[2], b[2])]
    found = lifecycle.interval_overlaps(intervals, "name", 60)
    assert rows(found) == sorted(pairs, key=repr) and len(pairs) > 50
    assert "NestedLoop" not in scans(found)
    with pytest.raises(ValueError):
        lifecycle.assign_interval(df.withColumnRenamed("id", "name"), intervals, "ts")
