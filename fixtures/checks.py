"""Registered queries: each runs an operator over the whole derived tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import Settings
from emberline.functions import calendar as cal
from emberline.functions import columns as cols
from emberline.operators import filters, lookups, merge, reconcile
from emberline.plans import chain, lifecycle, profile, views
from emberline.schema import PARTS
from emberline.sources import cold as cold_store
from emberline.sources import events as event_source
from emberline.sources import folders, registry, sync, users
from emberline.sources import log as message_log
from emberline.streaming import hot as hot_store
from emberline.streaming import interactions, metrics, rejects, run
from fixtures import inputs as given
from fixtures.inputs import AS_OF, D7, D15, FIRST, KINDS, LAST, ROW

CFG = Settings(zones=("zone_0", "zone_2", "zone_4", "zone_6", "zone_8"))
# For runs that must accept the whole month.
OPEN = replace(CFG, late_days=40, app_event_days=40, interaction_late_days=40)

# Messages of a written file of a feed with every mapped field.
FILE_ROWS = 100_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def compared(spark: SparkSession, sf: str, grain: str) -> DataFrame:
    full, lossy = given.classified(spark, sf), given.cold_defect(spark, sf)
    return reconcile.pct_diff(reconcile.reconcile(full, lossy, grain))


def event_stream(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    schema = given.table(spark, sf, "events").schema
    return event_source.read_events(spark, kind, sf, CFG, schema, "events.parquet")


def register(spark: SparkSession, path: str, schema: str, fmt: str = "orc", columns: list[str] = PARTS) -> str:
    """An external table over partition folders; its name."""
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING {fmt} PARTITIONED BY ({', '.join(columns)}) LOCATION '{path}'"
    )
    return name


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


# --- sources and sinks ---------------------------------------------------------


@query
def event_source_(spark, sf):
    ws = folders.workspace(spark, "event_source")
    rows = event_stream(spark, sf, "generic_interaction")
    q = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", f"{ws}/checkpoint")
        .option("path", f"{ws}/rows")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{ws}/rows")


def run_kinds(spark, sf, ws, dirty: bool, as_of: dt.date, cfg: Settings) -> str:
    """Feed every stream its own messages and run them side by side."""
    feed = given.messages(spark, sf, dirty).select("event_id", "payload", "kind")
    cold_store.write_partitions(feed, f"{ws}/feed", ["kind"], "parquet", row_group=event_source.ROW_GROUP)
    started = [
        run.run_stream(spark, kind, f"{ws}/feed/kind={kind}", f"{ws}/tables", lambda: as_of, cfg, once=True)
        for kind in KINDS.values()
    ]
    for q in started:
        q.awaitTermination()
    return f"{ws}/tables"


@query
def hot_upsert_sink(spark, sf):
    ws = folders.workspace(spark, "hot_upsert_sink")
    root = run_kinds(spark, sf, ws, False, AS_OF, OPEN)
    hot_store.fold(spark, f"{root}/hot_events", min_parts=4)
    return hot_store.read_hot(spark, f"{root}/hot_events").select(*ROW, "cell_id", "topic_name", "install_campaign_app_id")


@query
def hot_mapped_fields(spark, sf):
    """Messages of one stream with every mapped field; the hot row has the latest message's."""
    ws = folders.workspace(spark, "hot_mapped_fields")
    known = {"uniqueId": F.col("unique_id"), "event_id": F.col("event_id"), "user_id": F.col("user_id")}
    times = {"topology_entry_time": F.col("ts").cast("string"), "request_timestamp": F.col("event_date").cast("timestamp").cast("string")}
    sources = cols.mapped_fields()
    # Three batches, so that the latest message may come in any of them, each of as many files as its rows need.
    files = -(-given.table(spark, sf, "events").count() // (3 * FILE_ROWS)) or 1
    # Rows are dealt out as they are read: a message is more than ten times as large, and dealing sorts what a task has read.
    rows = given.raw(spark, sf).select("event_id", "user_id", "unique_id", "ts", "event_date", "event_type", "k").repartition(3 * files)
    mapped = {name: column for name, column in feed_fields(rows).items() if name in sources}
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in (known | times | mapped).items()]))
    rows.select("event_id", payload.alias("payload")).write.option("parquet.block.size", event_source.ROW_GROUP).parquet(f"{ws}/feed")
    run.run_stream(spark, "click", f"{ws}/feed", f"{ws}/tables", lambda: AS_OF, replace(OPEN, max_files_per_trigger=files), once=True).awaitTermination()
    return hot_store.read_hot(spark, f"{ws}/tables/hot_events").select("unique_id", *cols.mapped_targets())


@query
def cold_orc_sink(spark, sf):
    """Three hours one by one, as each is over, the others together."""
    ws = folders.workspace(spark, "cold_orc_sink")
    hot = given.ad_events(spark, sf)
    first = (F.col("event_month") == D7.month) & (F.col("event_day") == D7.day) & (F.col("event_hour") < 3)
    cold_store.sink_classes(hot.where(~first), ws)
    for hour in range(3):
        cold_store.sink_hour(hot, D7.year, D7.month, D7.day, hour, ws)
    return cold_store.read_cold(spark, ws, hot.schema)


@query
def cold_orc_sink_day(spark, sf):
    ws = folders.workspace(spark, "cold_orc_sink_day")
    hot = given.ad_events(spark, sf)
    cold_store.sink_day(hot, D7, ws)
    return cold_store.read_cold(spark, ws, hot.schema)


@query
def interaction_append(spark, sf):
    ws = folders.workspace(spark, "interaction_append")
    given.messages(spark, sf).select("event_id", "payload").write.parquet(f"{ws}/feed")
    run.run_stream(
        spark, "generic_interaction", f"{ws}/feed", f"{ws}/tables", lambda: AS_OF, OPEN, once=True
    ).awaitTermination()
    return interactions.read_interactions(spark, f"{ws}/tables/interactions")


@query
def ad_interaction_flag(spark, sf):
    events = given.raw(spark, sf)
    interacted = events.where(F.col("has_ad_interactions") == 1)
    return merge.merge_flagged(events.drop("has_ad_interactions"), interacted).select(*ROW)


@query
def bad_records_sink(spark, sf):
    ws = folders.workspace(spark, "bad_records_sink")
    batch = given.messages(spark, sf, dirty=True).select("event_id", "payload")
    judged = rejects.judge(batch, "request", AS_OF, OPEN)
    rejects.quarantine(judged.where(F.col("reason").isNotNull()), "request", 0, ws)
    return rejects.read_quarantine(spark, ws)


@query
def migrate_hour(spark, sf):
    ws = folders.workspace(spark, "migrate_hour")
    hot = given.ad_events(spark, sf)
    cold_store.migrate_hour(hot, 2024, 1, 29, 10, ws)
    return spark.read.schema(hot.schema).parquet(ws).select(*ROW)


@query
def migrate_day(spark, sf):
    ws = folders.workspace(spark, "migrate_day")
    hot = given.ad_events(spark, sf)
    cold_store.migrate_days(hot, AS_OF, 1, ws)
    return spark.read.schema(hot.schema).parquet(ws).select(*ROW)


@query
def partition_sync(spark, sf):
    kept = given.classified(spark, sf).where(F.col("event_class") != "unclassified")
    src = kept.where(F.col("event_date") != F.lit(LAST))
    dst = given.cold_defect(spark, sf).where(F.col("event_date") != F.lit(dt.date(2024, 1, 5)))
    # One day has the same rows but for a flag.
    flag = F.when(F.col("event_date") == F.lit(dt.date(2024, 1, 10)), F.lit(0)).otherwise(F.col("has_vast"))
    return sync.sync_plan(src, dst.withColumn("has_vast", flag))


def copies(spark, sf):
    """A source, and a copy that lacks a day, lost rows, and has a changed flag."""
    kept = given.classified(spark, sf).where(F.col("event_class") != "unclassified").drop("event_date")
    src = kept.where(cal.event_date() != F.lit(LAST))
    dst = given.cold_defect(spark, sf).drop("event_date").where(cal.event_date() != F.lit(dt.date(2024, 1, 5)))
    flag = F.when(cal.event_date() == F.lit(dt.date(2024, 1, 10)), F.lit(0)).otherwise(F.col("has_vast"))
    return src, dst.withColumn("has_vast", flag)


def stored_prints(spark, sf, ws):
    days = [FIRST + dt.timedelta(days=i) for i in range((LAST - FIRST).days + 1)]
    for name, rows in zip(("src", "dst"), copies(spark, sf)):
        sync.save_prints(rows, days, f"{ws}/{name}")
    return sync.prints_plan(sync.read_prints(spark, f"{ws}/src"), sync.read_prints(spark, f"{ws}/dst"))


@query
def partition_prints(spark, sf):
    return stored_prints(spark, sf, folders.workspace(spark, "partition_prints"))


@query
def sync_differences(spark, sf):
    plan = stored_prints(spark, sf, folders.workspace(spark, "sync_differences"))
    return sync.differing_rows(plan, *copies(spark, sf))


@query
def users_dim_load(spark, sf):
    return users.load_users(given.user_documents(spark, sf), AS_OF)


@query
def stream_metrics(spark, sf):
    ws = folders.workspace(spark, "stream_metrics")
    listener = metrics.metrics_listener(spark, f"{ws}/metrics")
    try:
        rows = event_stream(spark, sf, "generic_interaction")
        q = run.append_interactions(
            rows, f"{ws}/rows", f"{ws}/checkpoint", CFG, once=True, name="generic_interaction"
        )
        q.awaitTermination()
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return metrics.read_metrics(spark, f"{ws}/metrics")


@query
def rate_limited_source(spark, sf):
    ws = folders.workspace(spark, "rate_limited_source")
    topic = message_log.Topic(f"{ws}/topic")
    feed = given.messages(spark, sf, dirty=True).select("event_id", "payload")
    message_log.append_log(feed, topic.path, 3, 1500)
    run.drain(spark, "app_event", topic, f"{ws}/tables", lambda: AS_OF, OPEN)
    found = metrics.read_batches(spark, f"{ws}/tables/batch_metrics")
    whole = Window.partitionBy("app")
    sums = [F.sum(name).over(whole).alias(total) for name, total in (("input_rows", "all_rows"), ("kept_rows", "all_kept"))]
    return found.select("app", "batch_id", "input_rows", *sums)


@query
def batch_metrics(spark, sf):
    ws = folders.workspace(spark, "batch_metrics")
    root = run_kinds(spark, sf, ws, True, AS_OF, OPEN)
    return metrics.read_batches(spark, f"{root}/batch_metrics").drop("run")


# --- projections ---------------------------------------------------------------


def app_ids(df: DataFrame) -> DataFrame:
    k = F.col("k")
    return df.withColumns(
        {
            "AppId": F.when(k % 3 == 0, F.concat(F.lit("app"), k.cast("string"))),
            "app_id": F.when(k % 2 == 0, F.concat(F.lit("id"), k.cast("string"))),
        }
    )


def feed_fields(df: DataFrame) -> dict:
    """A value for every field that the feed maps, by its own name: text that tells which field it is, or nothing."""
    def value(i: int):
        text = F.concat(F.col("event_type"), F.lit("-"), ((F.col("k") + i) % 100).cast("string"))
        return F.when(F.col("k") % 7 != i % 7, text)

    fields = {pair.strip().split("-", 1)[0]: value(i) for i, pair in enumerate(cols.RENAMES.split(","))}
    ts = F.col("ts")
    whole = {"et_year": F.year(ts), "et_month": F.month(ts), "et_day": F.dayofmonth(ts), "et_hour": F.hour(ts), "uniqueid": F.col("unique_id")}
    return fields | whole


@query
def rename_map(spark, sf):
    """All pairs; source names come in any case."""
    rows = given.raw(spark, sf)
    fields = [column.alias(name.upper() if i % 3 else name) for i, (name, column) in enumerate(feed_fields(rows).items())]
    return cols.rename(rows.select("event_id", *fields))


@query
def rename_coalesce(spark, sf):
    return cols.rename(app_ids(given.raw(spark, sf)).select("event_id", "AppId", "app_id"))


@query
def partition_columns_last(spark, sf):
    return cols.partition_last(given.ad_events(spark, sf).select(*PARTS, *[c for c in ROW if c not in PARTS]))


@query
def utc_parts(spark, sf):
    text = F.concat(F.translate(F.substring(F.col("ts").cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    broken = F.when(F.col("k") == 50, "x").otherwise(text)
    return given.raw(spark, sf).select("event_id", *cal.utc_parts(broken))


@query
def calendar_offsets(spark, sf):
    days = given.table(spark, sf, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    shifted = cal.offsets(days, "o_orderdate", [2, 3, -1, -5, -6, -7, -8, -14, -15], [-1, -2])
    return shifted.groupBy("label", "year", "month", "day", "hour").agg(F.sum("n").alias("orders"))


@query
def legacy_schema_align(spark, sf):
    old = {new: name for name, new in cols.LEGACY_NAMES.items()}
    rows = given.ad_events(spark, sf)
    return cols.align_legacy(rows.select(*[F.col(c).alias(old.get(c, c)) for c in rows.columns]))


@query
def week_number(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return (
        given.table(spark, sf, "orders")
        .groupBy(day.alias("order_date"))
        .agg(F.count("*").alias("orders"))
        .withColumn("week_number", cal.week_u(F.col("order_date")))
    )


@query
def parse_events(spark, sf):
    feed = given.messages(spark, sf, dirty=True).select(F.col("event_id").alias("message_id"), "payload")
    return cols.parse(feed).select(
        "message_id", "unique_id", "ts", "request_ts", "zone", "corrupt", "bad_value"
    )


@query
def partition_derivation(spark, sf):
    rows = given.ad_events_raw(spark, sf).select("event_id", "unique_id", "request_ts")
    return cols.with_partitions(rows).drop("request_ts")


# --- filters -------------------------------------------------------------------


@query
def partition_slice(spark, sf):
    return filters.slice_(given.ad_events(spark, sf), D7.year, D7.month, D7.day)


@query
def fill_filter(spark, sf):
    return filters.fill(given.zero_flags(spark, sf))


@query
def nofill_filter(spark, sf):
    return filters.nofill(given.zero_flags(spark, sf))


@query
def classify_events(spark, sf):
    return filters.classify(given.zero_flags(spark, sf))


@query
def unclassified_audit(spark, sf):
    return filters.unclassified_audit(given.zero_flags(spark, sf))


@query
def click_filter(spark, sf):
    return filters.clicks(given.ad_events(spark, sf), D15, D7)


@query
def rolling_window_filter(spark, sf):
    return filters.window_(given.ad_events(spark, sf), D15, AS_OF)


@query
def history_filter(spark, sf):
    return filters.window_(given.ad_events(spark, sf), hi=D7)


@query
def zone_filter(spark, sf):
    return filters.in_zones(given.ad_events(spark, sf), CFG.zones)


@query
def late_event_filter(spark, sf):
    rows = given.raw(spark, sf).select("event_id", "ts", "event_type")
    at = dt.date(2024, 1, 25)
    kept = filters.timely(rows, at, CFG.late_days, CFG.create_ahead, "ts")
    out = filters.timely(rows, at, CFG.late_days, CFG.create_ahead, "ts", rejects=True)
    return kept.withColumn("status", F.lit("kept")).unionByName(out.withColumnRenamed("reason", "status"))


@query
def appevents_retention(spark, sf):
    rows = given.raw(spark, sf).where(given.stream_kind() == "app_event")
    limit = registry.max_age("app_event", CFG)
    return filters.timely(rows.select("event_id", "ts", "user_id", "value"), AS_OF, limit, ts_col="ts")


# --- merges and joins ----------------------------------------------------------


@query
def lifecycle_merge(spark, sf):
    return merge.merge_lifecycle(given.raw(spark, sf), stable=["event_date"]).select(*ROW)


@query
def merge_increment(spark, sf):
    events = given.raw(spark, sf)
    early = F.col("event_type").isin("view", "error")
    existing = merge.merge_states(merge.to_states(events.where(early)))
    return merge.present(merge.merge_increment(existing, events.where(~early))).select(*ROW)


@query
def user_enrich(spark, sf):
    return lookups.enrich(given.ad_events(spark, sf), given.users(spark, sf), CFG)


@query
def bucketed_enrich(spark, sf):
    """Facts and users stored in buckets of the user, as for a dimension too large to send."""
    ws = folders.workspace(spark, "bucketed_enrich")
    names = [f"b_{uuid.uuid4().hex}" for _ in range(2)]
    users = given.users(spark, sf).select("user_id", "nation", "segment")
    for name, rows in zip(names, (given.ad_events(spark, sf), users)):
        lookups.save_bucketed(rows, name, f"{ws}/{name}", "user_id", 8)
    return lookups.enrich_bucketed(spark, *names)


@query
def reconcile_join(spark, sf):
    return reconcile.reconcile(given.classified(spark, sf), given.cold_defect(spark, sf), "hour")


@query
def missing_partitions(spark, sf):
    return lookups.missing_partitions(filters.nofill(given.ad_events(spark, sf)), FIRST, LAST)


@query
def unprocessed_hours(spark, sf):
    date = dt.date(2024, 1, 29)
    return profile.unprocessed(given.ledger(spark, sf), given.JOB, date, date, 3)


@query
def stream_lookup(spark, sf):
    ws = folders.workspace(spark, "stream_lookup")
    rows = event_stream(spark, sf, "generic_interaction").select("event_id", "user_id", "event_type")
    side = lookups.Lookup(
        lambda: given.users(spark, sf).select("user_id", "nation", "segment"),
        CFG.lookup_refresh_seconds,
        "user_id",
        CFG,
    )
    run.run_lookup(rows, side, f"{ws}/rows", f"{ws}/checkpoint", CFG, once=True).awaitTermination()
    return spark.read.parquet(f"{ws}/rows").drop("run", "batch_id")


# --- aggregations --------------------------------------------------------------


@query
def daily_class_counts(spark, sf):
    return reconcile.daily_counts(given.classified(spark, sf))


@query
def hourly_counts(spark, sf):
    return reconcile.hourly_counts(filters.fill(given.ad_events(spark, sf)), D7)


@query
def count_pct_diff(spark, sf):
    return compared(spark, sf, "day")


@query
def reconcile_gate(spark, sf):
    return reconcile.gate(compared(spark, sf, "day"), CFG.tolerance_pct)


@query
def hourly_mismatch_alerts(spark, sf):
    return reconcile.mismatch_alerts(compared(spark, sf, "hour"), CFG.tolerance_pct)


@query
def monitor_counts(spark, sf):
    return reconcile.flag_counts(given.ad_events(spark, sf))


@query
def monitor_rollup(spark, sf):
    return reconcile.flag_rollup(given.ad_events(spark, sf))


@query
def availability_report(spark, sf):
    return reconcile.availability(
        {"hot": given.hot_events(spark, sf), "cold": given.cold_events(spark, sf)}
    )


@query
def partition_inventory(spark, sf):
    return reconcile.inventory(given.ad_events(spark, sf))


def drops(spark, sf):
    full = given.classified(spark, sf)
    dates = full.select("event_date").distinct()
    return lifecycle.drop_plan(full, given.cold_defect(spark, sf), AS_OF, CFG, dates)


@query
def action_digest(spark, sf):
    item = lifecycle.range_text("lower_date", "lower_hour", "upper_date", "upper_hour")
    return reconcile.digest(drops(spark, sf).select(F.col("action").alias("status"), item.alias("item")))


# --- views ---------------------------------------------------------------------


@query
def tier_view(spark, sf):
    hot, cold = given.hot_events(spark, sf).select(*ROW), given.cold_events(spark, sf)
    return views.tier_view(hot, cold, AS_OF, CFG)


@query
def clicks_view(spark, sf):
    hot, cold = given.hot_events(spark, sf).select(*ROW), given.cold_events(spark, sf)
    return views.clicks_view(hot, cold, AS_OF, CFG)


@query
def view_definition(spark, sf):
    ws = folders.workspace(spark, "view_definition")
    hot = cols.partition_last(given.hot_events(spark, sf).select(*ROW))
    cold = cols.partition_last(
        given.cold_events(spark, sf).where(F.col("event_class") == "fill").select(*ROW)
    )
    names = []
    for label, rows in (("hot", hot), ("cold", cold)):
        cold_store.write_partitions(rows, f"{ws}/{label}", PARTS, "orc")
        names.append(register(spark, f"{ws}/{label}", ddl(rows)))
        spark.sql(f"MSCK REPAIR TABLE {names[-1]}")
    hot_from, cold_from = views.cutoffs(AS_OF, CFG)
    view = f"v_{names[0]}"
    recent, older = views.window_sql(hot_from, AS_OF), views.window_sql(cold_from, hot_from)
    views.define_view(spark, view, *names, "true", "true")
    return views.define_view(spark, view, *names, recent, older)


@query
def tier_overlap_audit(spark, sf):
    return views.overlap_audit(given.hot_events(spark, sf), given.cold_events(spark, sf))


# --- lifecycle -----------------------------------------------------------------


def order_days(spark, sf):
    day = F.col("o_orderdate").cast("date").alias("as_of")
    return given.table(spark, sf, "orders").select(day).distinct()


@query
def range_plan_halfday(spark, sf):
    return lifecycle.range_plan(order_days(spark, sf), CFG.create_ahead, 12)


@query
def range_plan_day(spark, sf):
    return lifecycle.range_plan(order_days(spark, sf), CFG.create_ahead, 24)


@query
def range_assign(spark, sf):
    gap = F.col("event_date") != F.lit(dt.date(2024, 1, 13))
    days = cal.day_calendar(spark, FIRST, LAST).where(gap)
    rows = given.ad_events(spark, sf)
    return lifecycle.assign_range(rows, lifecycle.ranges_of(days, 12)).select(
        "unique_id", "event_hour", "lower_date", "lower_hour", "covered"
    )


def intervals(spark, sf):
    """Orders as intervals: from a time on, for some minutes, an hour, or days."""
    number = F.col("n")
    at = F.timestamp_add("MINUTE", number * 95, F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz"))
    long = F.when(number % 40 == 0, 11 * 1440).when(number % 7 == 0, 20).otherwise(70)
    keys = given.table(spark, sf, "orders").select((F.col("o_orderkey") % 300).cast("int").alias("n")).distinct()
    return keys.select(number.alias("interval_id"), at.alias("lo"), F.timestamp_add("MINUTE", long, at).alias("hi"))


@query
def interval_assign(spark, sf):
    rows = given.ad_events(spark, sf).select("unique_id", "request_ts")
    return lifecycle.assign_interval(rows, intervals(spark, sf))


@query
def interval_overlaps(spark, sf):
    return lifecycle.interval_overlaps(intervals(spark, sf), "interval_id")


@query
def gated_drop_plan(spark, sf):
    return drops(spark, sf)


@query
def partition_discovery(spark, sf):
    ws = folders.workspace(spark, "partition_discovery")
    rows = cols.partition_last(filters.fill(given.ad_events(spark, sf)))
    cold_store.write_partitions(filters.window_(rows, hi=D7), ws, PARTS, "orc")
    table = register(spark, ws, ddl(rows))
    spark.sql(f"MSCK REPAIR TABLE {table}")
    cold_store.write_partitions(filters.window_(rows, lo=D7), ws, PARTS, "orc")
    return lifecycle.discover(spark, table)


@query
def compact_to_clicks(spark, sf):
    ws = folders.workspace(spark, "compact_to_clicks")
    rows = cols.partition_last(filters.fill(given.ad_events(spark, sf)))
    cold_store.write_partitions(rows, ws, PARTS, "orc")
    stored = spark.read.schema(rows.schema).orc(ws)
    lifecycle.compact_clicks(stored, D15, ws)
    return spark.read.schema(rows.schema).orc(ws)


@query
def nofill_retention(spark, sf):
    return lifecycle.nofill_survivors(filters.nofill(given.ad_events(spark, sf)), AS_OF, CFG.cold_days)


@query
def nofill_retention_plan(spark, sf):
    rows = filters.nofill(given.ad_events(spark, sf))
    return lifecycle.nofill_plan(rows, dt.date(2024, 2, 16), CFG.cold_days)


@query
def failed_day_reset(spark, sf):
    ws = folders.workspace(spark, "failed_day_reset")
    cold_store.sink_day(given.ad_events(spark, sf), D7, ws)
    return lifecycle.reset_days(spark, ws, D7)


@query
def tier_plan(spark, sf):
    day = F.col("ts").cast("date")
    bounds = given.table(spark, sf, "events").agg(
        F.min(day).alias("lo"), F.date_add(F.max(day), 3).alias("hi")
    )
    return lifecycle.tier_plan(bounds, AS_OF, CFG)


@query
def daily_chain(spark, sf):
    ws = folders.workspace(spark, "daily_chain")
    rows = cols.partition_last(given.hot_events(spark, sf).select(*ROW))
    cold_store.write_partitions(rows, f"{ws}/hot", PARTS, "parquet")
    hot = spark.read.schema(rows.schema).parquet(f"{ws}/hot")
    tables = register(spark, f"{ws}/hot", ddl(rows), "parquet"), register(spark, f"{ws}/cold", ddl(rows.withColumn("event_class", F.lit(""))), "orc", ["event_class", *PARTS])
    view = chain.CatalogView(f"v_{tables[0]}", *tables)
    spark.sql(f"MSCK REPAIR TABLE {tables[0]}")
    # As the chain of the day before left it, before anything was sunk.
    views.switch_view(spark, view.name, view.hot, view.cold, AS_OF - dt.timedelta(days=1), CFG)
    try:
        report = chain.daily_chain(hot, f"{ws}/cold", AS_OF, CFG, hot_dir=f"{ws}/hot", view=view)
        report = spark.createDataFrame(report.collect(), report.schema)
    finally:
        spark.sql(f"DROP VIEW {view.name}")
        for name in tables:
            spark.sql(f"DROP TABLE {name}")
    return report


# --- streaming -----------------------------------------------------------------

SLOTS = ((FIRST, dt.date(2024, 1, 10)), (dt.date(2024, 1, 11), dt.date(2024, 1, 20)), (dt.date(2024, 1, 21), LAST))


def feed_in_slots(spark, sf, ws, dirty: bool, cfg: Settings) -> str:
    """Three arrivals, each taken by a query that starts from the last checkpoint."""
    for i, (lo, hi) in enumerate(SLOTS):
        part = given.messages(spark, sf, dirty).where(F.col("event_date").between(F.lit(lo), F.lit(hi)))
        part.select("event_id", "payload").write.parquet(f"{ws}/feed/slot={i}")
        run.run_stream(
            spark, "request", f"{ws}/feed", f"{ws}/tables", lambda: AS_OF, cfg, once=True
        ).awaitTermination()
    return f"{ws}/tables"


@query
def checkpoint_resume(spark, sf):
    ws = folders.workspace(spark, "checkpoint_resume")
    root = feed_in_slots(spark, sf, ws, False, OPEN)
    run.run_stream(
        spark, "request", f"{ws}/feed", root, lambda: AS_OF, OPEN, once=True
    ).awaitTermination()
    return hot_store.read_hot(spark, f"{root}/hot_events").select(*ROW)


@query
def stream_registry(spark, sf):
    found = (
        given.table(spark, sf, "events")
        .groupBy(given.stream_kind().alias("kind"))
        .agg(F.count("*").alias("n"))
    )
    listed = registry.registry(spark)
    return listed.join(found, "kind", "left").select(
        *listed.columns, F.coalesce("n", F.lit(0)).alias("events")
    )


@query
def bad_record_routing(spark, sf):
    ws = folders.workspace(spark, "bad_record_routing")
    cfg = replace(CFG, late_days=18, bad_record_kinds=tuple(KINDS.values()))
    root = run_kinds(spark, sf, ws, True, dt.date(2024, 1, 27), cfg)
    return rejects.read_quarantine(spark, f"{root}/bad_records")


@query
def bad_record_cadence(spark, sf):
    ws = folders.workspace(spark, "bad_record_cadence")
    cfg = replace(OPEN, bad_record_every={"request": 2})
    root = feed_in_slots(spark, sf, ws, True, cfg)
    return spark.read.schema("batch_id bigint, reason string, rows bigint, app string, at bigint").parquet(
        f"{root}/bad_reports"
    ).select("app", "batch_id", "reason", "rows")


@query
def stream_late_data(spark, sf):
    ws = folders.workspace(spark, "stream_late_data")
    root = run_kinds(spark, sf, ws, False, AS_OF, CFG)
    return hot_store.read_hot(spark, f"{root}/hot_events").select(*ROW)


@query
def stream_hourly_counts(spark, sf):
    ws = folders.workspace(spark, "stream_hourly_counts")
    counts = run.stream_counts(event_stream(spark, sf, "generic_interaction"))
    run.run_counts(counts, f"{ws}/rows", f"{ws}/checkpoint", CFG, once=True).awaitTermination()
    return run.read_counts(spark, f"{ws}/rows")


@query
def stream_dedupe(spark, sf):
    """The feed comes twice, in two arrivals."""
    ws = folders.workspace(spark, "stream_dedupe")
    rows = given.table(spark, sf, "events")
    run.state_in_rocksdb(spark)
    try:
        for i in range(2):
            rows.write.parquet(f"{ws}/feed/arrival={i}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{ws}/feed")
            run.append_interactions(stream, f"{ws}/rows", f"{ws}/checkpoint", CFG, once=True, within="40 days").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{ws}/rows").select("event_id", "user_id", "event_type", *PARTS)


@query
def stream_daily_rollup(spark, sf):
    """Two arrivals, the second with rows of days that the first had; a later row closes the windows."""
    ws = folders.workspace(spark, "stream_daily_rollup")
    rows = given.table(spark, sf, "events").select("ts", "event_type")
    after = rows.agg((F.max("ts") + F.expr("INTERVAL 90 DAY")).alias("ts"), F.lit("after").alias("event_type"))
    late = F.pmod(F.xxhash64("ts"), F.lit(4)) == 0
    for i, part in enumerate((rows.where(~late), rows.where(late), after)):
        part.write.parquet(f"{ws}/feed/arrival={i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{ws}/feed")
        run.run_rollup(run.rollup(stream, "60 days")[1], f"{ws}/days", f"{ws}/checkpoint", CFG, once=True).awaitTermination()
    return spark.read.parquet(f"{ws}/days").where("event_type <> 'after'")


@query
def stream_freshness(spark, sf):
    rows = given.table(spark, sf, "events").select(given.stream_kind().alias("kind"), "ts")
    return run.freshness(rows, registry.registry(spark), dt.datetime(2024, 1, 31), 1)


# --- profile and ledger --------------------------------------------------------


@query
def profile_hour(spark, sf):
    return profile.profile_hour(given.ad_events(spark, sf), 2024, 1, 29, 10, CFG.zones)


@query
def profile_week(spark, sf):
    return profile.profile_week(profile.profile_hours(given.ad_events(spark, sf), CFG.zones))


@query
def profile_corrected(spark, sf):
    """Hours that were first taken from incomplete rows run again, some with nothing."""
    ws = folders.workspace(spark, "profile_corrected")
    full = given.classified(spark, sf).where(F.col("event_class") != "unclassified")
    days = [FIRST + dt.timedelta(days=i) for i in range((LAST - FIRST).days + 1)]
    hours = [dt.datetime.combine(day, dt.time(h)) for day in days for h in range(24)]
    first = given.cold_defect(spark, sf).where((F.dayofmonth("event_date") != 7))
    profile.apply_hours(profile.profile_hours(first, CFG.zones), hours, 1, ws)
    profile.fold_weeks(spark, ws, 1)
    odd = full.where(F.dayofmonth("event_date") % 2 == 1)
    profile.apply_hours(profile.profile_hours(odd, CFG.zones), [at for at in hours if at.day % 2], 2, ws)
    return profile.read_weeks(spark, ws)


@query
def profile_backfill(spark, sf):
    return profile.profile_backfill(
        given.cold_events(spark, sf), D7.year, D7.month, D7.day, 10, CFG.zones
    )


def changes(spark, sf):
    expected = given.classified(spark, sf).where(F.col("event_class") != "unclassified")
    return profile.change_gate(expected, given.cold_defect(spark, sf), CFG.profile_tolerance_pct)


@query
def profile_change_gate(spark, sf):
    return changes(spark, sf)


@query
def ledger_append(spark, sf):
    hour = F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour_ts")
    hours = given.table(spark, sf, "events").select(hour).distinct()
    ws = folders.workspace(spark, "ledger_append")
    profile.append_ledger(profile.ledger_rows(hours, given.JOB), ws)
    tried = hours.where(F.hour("hour_ts") % 2 == 0)
    profile.append_ledger(profile.close_hours(tried, given.JOB, True, 1), ws)
    profile.append_ledger(profile.close_hours(hours.join(tried, "hour_ts", "left_anti"), given.JOB, False, 1), ws)
    return profile.read_ledger(spark, ws)


@query
def reprocess_plan(spark, sf):
    return profile.reprocess_plan(given.ledger(spark, sf), given.JOB, changes(spark, sf), CFG.max_retries)


QUERIES["event_source"] = QUERIES.pop("event_source_")
