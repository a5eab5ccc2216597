"""Flag logic, date windows and lateness."""

import datetime as dt

from pyspark.sql import functions as F

from emberline.operators import filters
from emberline.schema import OUTCOMES

FLAGS = "n int, has_request int, has_impression int, has_click int, has_install int, has_lead int, has_postinstall int, has_vast int"


def flagged(spark):
    none = (None,) * 5
    return spark.createDataFrame(
        [
            (1, 1, None, *none),
            (2, 1, 0, *none),
            (3, 1, 1, *none),
            (4, None, None, *none),
            (5, 0, None, *none),
            (6, None, 1, *none),
        ],
        FLAGS,
    )


def test_classes_keep_null_and_zero_apart(spark):
    got = {r.n: r.event_class for r in filters.classify(flagged(spark)).collect()}
    assert got == {1: "nofill", 2: "unclassified", 3: "fill", 4: "unclassified", 5: "unclassified", 6: "fill"}


def test_classes_are_a_partition(spark):
    df = flagged(spark)
    fill, nofill = filters.fill(df).count(), filters.nofill(df).count()
    rest = filters.classify(df).where("event_class = 'unclassified'").count()
    assert (fill, nofill, rest) == (2, 1, 3)


def test_audit_reasons(spark):
    df = flagged(spark).selectExpr("*", "2024 AS event_year", "1 AS event_month", "2 AS event_day")
    got = {r.reason: r.rows for r in filters.unclassified_audit(df).collect()}
    assert got == {"zero_flag": 1, "no_request": 2}


def days(spark, *dates):
    return spark.createDataFrame(
        [(d.year, d.month, d.day, c) for d, c in dates],
        "event_year int, event_month int, event_day int, has_click int",
    )


def test_clicks_condition_binds_to_the_whole_window(spark):
    df = days(spark, (dt.date(2023, 5, 1), 0), (dt.date(2024, 1, 2), 1), (dt.date(2023, 5, 2), 1))
    got = filters.clicks(df, hi=dt.date(2024, 1, 2)).collect()
    assert sorted((r.event_year, r.has_click) for r in got) == [(2023, 1), (2024, 1)]


def test_window_crosses_year(spark):
    df = days(spark, *[(dt.date(2023, 12, 25) + dt.timedelta(days=i), 1) for i in range(20)])
    got = filters.window_(df, dt.date(2023, 12, 30), dt.date(2024, 1, 2)).collect()
    assert sorted((r.event_month, r.event_day) for r in got) == [(1, 1), (1, 2), (12, 31)]


def test_timely_keeps_both_edges(spark):
    as_of = dt.date(2024, 1, 30)
    df = spark.createDataFrame(
        [(n, as_of + dt.timedelta(days=n)) for n in (-7, -6, 0, 2, 3)], "n int, day date"
    ).select("n", F.col("day").cast("timestamp_ntz").alias("request_ts"))
    assert sorted(r.n for r in filters.timely(df, as_of, 6).collect()) == [-6, 0, 2]
    out = {r.n: r.reason for r in filters.timely(df, as_of, 6, rejects=True).collect()}
    assert out == {-7: "too_late", 3: "future"}


def test_stored_windows_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = days(spark, *[(dt.date(2024, 1, d), 1) for d in range(1, 31)]).withColumn("event_hour", F.lit(1))
    df.write.partitionBy("event_year", "event_month", "event_day", "event_hour").orc(path)
    plan = filters.window_(spark.read.orc(path), dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in text or "PartitionFilters: [(make_date" in text
    assert plan.count() == 2


def test_outcomes_do_not_include_request():
    assert "has_request" not in OUTCOMES
