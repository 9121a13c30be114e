"""Streams with late, disordered and missing events."""

from datetime import datetime, timedelta

import pandas as pd

from emberlog.streaming import correlate as live

SCHEMA = "row_id string, event_ts timestamp, event_name string, account string, region string, actor struct<arn:string,user_name:string,principal_id:string>"
T0 = datetime(2026, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def run(spark, folder, name, batches, make, mode="append"):
    """Feeds each batch as files of its own, one micro-batch after the other; the rows of the sink."""
    (folder / "in").mkdir()
    stream = make(spark.readStream.schema(SCHEMA).parquet(str(folder / "in")))
    for i, rows in enumerate(batches):
        data = [(f"{i}-{j}", ts, event, account, "r", (actor, None, None)) for j, (ts, event, account, actor) in enumerate(rows)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    return spark.read.schema(stream.schema).parquet(str(folder / name)).collect()


def test_gaps_in_order_of_time_whatever_the_order_of_arrival(spark, tmp_path):
    batches = [
        [(at(10), "StartLogging", "1", "b"), (at(0), "StopLogging", "1", "a"), (at(3), "StopLogging", "2", "c")],  # disordered
        [(at(4), "StopLogging", "1", "late"), (at(12), "StartLogging", "2", "c"), (None, "StopLogging", "1", "x")],  # late by 6 minutes: replaces the first start
        [(at(200), "ListUsers", "9", "z"), (at(200), "StopLogging", "3", "open")],
        [(at(1), "StopLogging", "1", "too late"), (at(300), "StartLogging", "9", "z")],
        [(at(301), "StopLogging", "9", "z")],
    ]
    got = run(spark, tmp_path, "gaps", batches, lambda s: live.logging_gaps(s, "'trail'", late="10 minutes", report=timedelta(minutes=30)))
    closed = sorted((r.account, r.start, r.end, r.disabled_by, r.duration_minutes) for r in got if not r.still_open)
    assert closed == [("1", at(4), at(10), "late", 6.0), ("2", at(3), at(12), "c", 9.0)]
    assert [(r.account, r.start, r.end) for r in got if r.still_open] == [("3", at(200), None)]


def test_open_gaps_are_reported_once_and_forgotten(spark, tmp_path):
    batches = [[(at(0), "StopLogging", "1", "a")], [(at(100), "StopLogging", "2", "b")], [(at(5000), "StartLogging", "1", "a")], [(at(9000), "StartLogging", "3", "a")], [(at(9001), "StartLogging", "3", "a")]]
    got = run(spark, tmp_path, "gaps", batches, lambda s: live.logging_gaps(s, "'trail'", late="1 minute", report=timedelta(minutes=60), forget=timedelta(minutes=1000)))
    assert sorted((r.account, r.still_open) for r in got) == [("1", True), ("2", True)]  # the end after 5000 minutes meets no state


def test_followers_with_late_rows(spark, tmp_path):
    batches = [[(at(0), "ConsoleLogin", "1", "a"), (at(30), "ConsoleLogin", "1", "a")], [(at(10), "CreateUser", "1", "a"), (at(40), "CreateUser", "1", "a"), (at(31), "CreateUser", "1", "other")], [(at(500), "ListUsers", "1", "z")], [(at(20), "CreateUser", "1", "a")]]
    got = run(spark, tmp_path, "steps", batches, lambda s: live.followers(s, minutes=15, late="60 minutes"))
    assert sorted((r.actor, r.access_ts, r.ts) for r in got) == [("a", at(0), at(10)), ("a", at(30), at(40))]


def test_activity_windows_close_with_the_watermark(spark, tmp_path):
    batches = [[(at(1), "x", "1", "a"), (at(59), "x", "1", "a"), (at(61), "x", "1", "b")], [(at(30), "x", "1", "a")], [(at(200), "x", "1", "a")], [(at(2), "x", "1", "a"), (at(400), "x", "1", "a")], [(at(900), "x", "1", "a")]]
    got = run(spark, tmp_path, "activity", batches, lambda s: live.activity(s, "1 hour", "30 minutes"))
    assert sorted((pd.Timestamp(r.window.start).to_pydatetime(), r.actor, r.n) for r in got) == [(at(0), "a", 3), (at(60), "b", 1), (at(180), "a", 1), (at(360), "a", 1)]
