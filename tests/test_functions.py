"""Hand-made edges of calendar and column functions."""

import datetime as dt
import json

from pyspark.sql import functions as F

from emberline.functions import calendar as cal
from emberline.functions import columns as cols
from emberline.schema import PARTS


def test_utc_parts(spark, rows):
    texts = ["2021-04-07T00:05:00Z", "2020-02-29T23:59:59Z", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.year, r.month, r.day, r.hour) for r in df.select("t", *cal.utc_parts(F.col("t"))).collect()}
    assert got == {
        "2021-04-07T00:05:00Z": (2021, 4, 7, 0),
        "2020-02-29T23:59:59Z": (2020, 2, 29, 23),
        "x": (None,) * 4,
        "": (None,) * 4,
    }


def test_week_starts_on_sunday(spark):
    days = ["2021-01-01", "2021-01-03", "2021-03-21", "2022-12-31", "2023-01-01", "2024-12-31", "2024-02-29"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    got = {r.d: r.w for r in df.select("d", cal.week_u(F.col("d")).alias("w")).collect()}
    assert got == {d: int(d.strftime("%U")) for d in got}
    assert got[dt.date(2021, 3, 21)] == 12


def test_offsets_cross_borders(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 3, 1, 0),), (dt.datetime(2024, 1, 1, 1),)], "at timestamp"
    ).select(F.col("at").cast("timestamp_ntz").alias("at"))
    got = {(r.at, r.label): (r.year, r.month, r.day, r.hour) for r in cal.offsets(df, "at", [-1, 2], [-2]).collect()}
    leap, year = dt.datetime(2024, 3, 1, 0), dt.datetime(2024, 1, 1, 1)
    assert got[leap, "-1d"] == (2024, 2, 29, 0)
    assert got[leap, "-2h"] == (2024, 2, 29, 22)
    assert got[year, "-2h"] == (2023, 12, 31, 23)
    assert got[year, "+2d"] == (2024, 1, 3, 1)


def test_rename_takes_first_in_spec_order(spark, rows):
    df = spark.createDataFrame(
        [("a", None, 1), (None, "b", 2), ("a", "b", 3), (None, None, 4)], "APPID string, app_id string, other int"
    )
    out = cols.rename(df)
    assert out.columns == ["install_campaign_app_id", "other"]
    assert {r.other: r.install_campaign_app_id for r in out.collect()} == {1: "a", 2: "b", 3: "a", 4: None}


def test_rename_spec_order_beats_column_order(spark):
    df = spark.createDataFrame([("second", "first")], "app_id string, appid string")
    assert cols.rename(df).first()[0] == "first"


def test_rename_one_source_only(spark):
    assert cols.rename(spark.createDataFrame([("b",)], "app_id string")).columns == ["install_campaign_app_id"]


def test_rename_map_size():
    assert len(cols.RENAMES.split(",")) == 59


def test_partition_columns_go_last(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "event_hour int, b int, event_year int, a int, event_day int, event_month int")
    assert cols.partition_last(df).columns == ["b", "a", *PARTS]


def test_parse_marks_faults(spark):
    texts = [
        '{"uniqueId":"u","event_id":1,"topology_entry_time":"2024-01-30 10:00:00","request_timestamp":"2024-01-30 10:00:00"}',
        "{bad",
        '{"uniqueId":"u","has_click":"x"}',
        '{"event_id":1}',
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, payload string")
    got = {r.n: r for r in cols.parse(df).collect()}
    assert (got[0].unique_id, got[0].ts, got[0].bad_value, got[0].corrupt) == (
        "u", dt.datetime(2024, 1, 30, 10), False, None,
    )
    assert got[1].corrupt == "{bad"
    assert got[2].bad_value and got[2].corrupt is None and got[2].has_click is None
    assert got[3].unique_id is None and not got[3].bad_value
    assert got[4].unique_id is None and got[4].corrupt is None


def test_mapped_fields_are_one_column(spark):
    """As renamed columns of one object; plans carry no column for each field."""
    texts = ['{"uniqueId":"u","appid":null,"app_id":"b","cellid":7,"gpscity":""}', '{"uniqueId":"u","appid":"a","app_id":"b"}', '{"uniqueId":"u"}', "{bad", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, payload string")
    out = cols.parse(df, details="held")
    assert len(out.columns) < 25
    got = {r.n: r.held and json.loads(r.held) for r in out.collect()}
    assert got == {0: {"install_campaign_app_id": "b", "cell_id": "7", "city": ""}, 1: {"install_campaign_app_id": "a"}, 2: None, 3: None, 4: None}
