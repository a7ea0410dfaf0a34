import datetime as dt

import pytest
from pyspark.sql import functions as F

from notefold.operators.timestamps import disagreeing_days, iso_day, normalize_notes

NOTE = "note_id string, board_id string, publish_time_raw string, publish_time_iso string, fetched_at timestamp, extra string"
FETCHED = dt.datetime(2024, 5, 2, 1, 30)
CASES = [
    ("1714613400", "b1", "2024-05-02 01:30:00", "epoch"), ("1714613400123", "b1", "2024-05-02 01:30:00.123", "epoch"), ("1714613400.5", "b1", "2024-05-02 01:30:00.5", "epoch"),
    ("2024-05-02 09:30", "b1", "2024-05-02 01:30:00", "local"), ("编辑于 2024-05-02 09:30", "b1", "2024-05-02 01:30:00", "local"), ("2024年5月2日 上午12:05", "b1", "2024-05-01 16:05:00", "local"), ("2024年5月2日 下午1:05", "b1", "2024-05-02 05:05:00", "local"),
    ("2024/5/2 01:16 (UTC+05:30)", None, "2024-05-01 19:46:00", "offset"), ("2024年5月2日 03:28（北京时间）", None, "2024-05-01 19:28:00", "offset"), ("20240502T063752+0800", None, "2024-05-01 22:37:52", "offset"), ("Apr 1, 2024 8:15 AM GMT-07:00", None, "2024-04-01 15:15:00", "offset"),
    ("Mon, 01 Apr 2024 04:51:34 +0200", None, "2024-04-01 02:51:34", "offset"), ("2024-05-02 09:41:20 America/New_York", None, "2024-05-02 13:41:20", "named_zone"), ("3小时前", None, "2024-05-01 22:30:00", "hours_ago"), ("昨天 08:00", "b1", "2024-05-01 00:00:00", "yesterday"),
    ("2024-05-02 09:30", None, None, "local"), ("2024-13-02 09:30", "b1", None, None), ("2024-05-02 25:00", "b1", None, None), ("2024年5月2日 下午13:05", "b1", None, None), ("刚刚编辑", "b1", None, None), ("", "b1", None, None), (None, "b1", None, None), ("2024-05-02 09:41:20 Mars/Base", None, None, "named_zone"),
]


def _run(spark, rows):
    notes = spark.createDataFrame(rows, NOTE)
    zones = spark.createDataFrame([("b1", "Asia/Shanghai"), ("b1", "Asia/Shanghai"), ("b2", "America/New_York"), (None, "UTC")], "board_id string, zone_name string")
    return notes, zones


def test_cascade(spark):
    rows = [(str(i), b, raw, None, FETCHED, "x") for i, (raw, b, _, _) in enumerate(CASES)]
    got = {r.note_id: r for r in normalize_notes(*_run(spark, rows)).select("note_id", "t.kind", F.col("t.utc").cast("string").alias("utc")).collect()}
    for i, (raw, _, utc, kind) in enumerate(CASES):
        assert (got[str(i)].kind, got[str(i)].utc) == (kind, utc), raw


def test_daylight_saving_policy(spark):
    rows = [("gap", "b2", "2024-03-10 02:30", None, FETCHED, ""), ("twice", "b2", "2024-11-03 01:30", None, FETCHED, ""), ("plain", "b2", "2024-06-03 01:30", None, FETCHED, "")]
    got = {r.note_id: (r.dst, r.utc) for r in normalize_notes(*_run(spark, rows)).select("note_id", "t.dst", F.col("t.utc").cast("string").alias("utc")).collect()}
    assert got == {"gap": ("nonexistent", "2024-03-10 07:30:00"), "twice": ("ambiguous", "2024-11-03 05:30:00"), "plain": (None, "2024-06-03 05:30:00")}


def test_days_that_disagree(spark):
    rows = [("a", "b1", "2024-05-02 03:00", "2024-05-02", FETCHED, ""), ("a", "b1", "2024-05-02 03:00", "2024-05-02", FETCHED, ""), ("b", "b1", "2024.05.02", "2024-05-02T23:00:00+08:00", FETCHED, ""), ("c", "b1", "2024.05.02", None, FETCHED, ""), ("d", "b1", "昨天 23:00", "2024-05-02", FETCHED, ""), ("e", None, "昨天 23:00", "2024-05-02", FETCHED, "")]
    assert sorted(r[0] for r in disagreeing_days(*_run(spark, rows)).collect()) == ["a", "d"]
    assert disagreeing_days(*_run(spark, [])).count() == 0


@pytest.mark.parametrize("text,day", [("2024-05-02", "2024-05-02"), ("2024-05-02T01:00:00+08:00", "2024-05-01"), ("2024-05-02T23:30:00Z", "2024-05-02"), ("2024-02-30", None), ("02.05.2024", None), (None, None)])
def test_iso(spark, text, day):
    assert spark.createDataFrame([(text,)], "t string").select(iso_day(F.col("t")).cast("string")).first()[0] == day
