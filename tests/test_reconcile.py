"""Percent rule, gate, alerts and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.operators import reconcile

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize(
    "hot, cold, pct, passed",
    [
        (0, 0, 0.0, True),
        (5, 0, 100.0, False),
        (0, 5, -100.0, False),
        (100, 100, 0.0, True),
        (101, 100, 1.0, False),
        (99, 100, -1.0, False),
        (1000, 999, 100 / 999, True),
    ],
)
def test_percent_and_gate(spark, hot, cold, pct, passed):
    df = spark.createDataFrame([(DAY, "fill", hot, cold)], "event_date date, event_class string, hot_rows bigint, cold_rows bigint")
    diffs = reconcile.pct_diff(df)
    assert diffs.first().pct_diff == pytest.approx(pct)
    assert reconcile.gate(diffs).first().passed is passed
    alerts = reconcile.mismatch_alerts(diffs.withColumn("event_hour", F.lit(3)))
    assert alerts.count() == (0 if passed else 1)


def test_gate_needs_both_classes(spark):
    df = spark.createDataFrame(
        [(DAY, "fill", 0.2), (DAY, "nofill", 5.0), (dt.date(2024, 1, 2), "fill", -0.9)],
        "event_date date, event_class string, pct_diff double",
    )
    assert {r.event_date.day: r.passed for r in reconcile.gate(df).collect()} == {1: False, 2: True}


def table(spark, *rows):
    return spark.createDataFrame(
        [(*r, dt.datetime(r[0], r[1], r[2])) for r in rows],
        "event_year int, event_month int, event_day int, event_hour int, event_class string, request_ts timestamp_ntz",
    )


def test_reconcile_counts_absent_sides_as_zero(spark, rows):
    hot = table(spark, (2024, 1, 1, 0, "fill"), (2024, 1, 1, 5, "fill"))
    cold = table(spark, (2024, 1, 1, 0, "fill"), (2024, 1, 2, 0, "nofill"))
    assert rows(reconcile.reconcile(hot, cold)) == [
        (dt.date(2024, 1, 1), "fill", 2, 1),
        (dt.date(2024, 1, 2), "nofill", 0, 1),
    ]
    assert len(rows(reconcile.reconcile(hot, cold, "hour"))) == 3


def test_hourly_counts_fill_zeros(spark):
    df = table(spark, (2024, 1, 1, 0, "fill"), (2024, 1, 1, 0, "fill"), (2024, 1, 1, 23, "fill"), (2024, 1, 2, 3, "fill"))
    got = {r.event_hour: r.rows for r in reconcile.hourly_counts(df, DAY).collect()}
    assert len(got) == 24 and got[0] == 2 and got[23] == 1 and got[3] == 0


def test_availability_orders_months_as_dates(spark):
    df = table(spark, (2024, 9, 30, 0, "fill"), (2024, 10, 1, 0, "fill"))
    got = reconcile.availability({"cold": df}).first()
    assert (got.first_date, got.last_date, got.rows) == (dt.date(2024, 9, 30), dt.date(2024, 10, 1), 2)


def test_digest_lists_sorted(spark, rows):
    df = spark.createDataFrame([("drop", "b"), ("drop", "a"), ("hold", "c")], "status string, item string")
    assert rows(reconcile.digest(df)) == [("drop", "a<br>b"), ("hold", "c")]
