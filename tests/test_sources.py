"""Feeds of a provider, partition schemes, and the nested package."""

import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators import correlate, package
from emberlog.sources import events as sources
from emberlog.sources import feeds


class Provider:
    def __init__(self, feed):
        self.feed = feed

    def lookup(self, kind, values):
        assert len(values) <= 2
        if kind == "sha256":
            raise TimeoutError("no answer")
        return {v: {"category": "APT28 relay" if v.startswith("1") else None, "confidence": 60} for v in values if "bad" not in v} | {"not asked": {}}


def test_feed_of_a_provider(spark):
    asked = spark.createDataFrame([("ip", "1.1.1.1"), ("ip", "1.1.1.1"), ("ip", "2.2.2.2"), ("domain", "BAD.example"), ("domain", "Good.example"), ("sha256", "ab"), ("ip", "3.3.3.3")], "kind string, value string")
    entries, failures = feeds.lookup(asked, "tests.test_sources:Provider", "live", batch=2)
    got = {r.indicator: (r.feed, r.kind, r.confidence, r.category, r.group_id) for r in entries.collect()}
    assert got == {"1.1.1.1": ("live", "ip", 60, "APT28 relay", "G0007"), "2.2.2.2": ("live", "ip", 60, "suspicious", None), "3.3.3.3": ("live", "ip", 60, "suspicious", None), "good.example": ("live", "domain", 60, "suspicious", None)}
    assert [(r.kind, r.indicator, r.error) for r in failures.collect()] == [("sha256", "ab", "TimeoutError: no answer")]


@pytest.mark.parametrize(("scheme", "parts"), [("ymd", ["year", "month", "day"]), ("timestamp", ["timestamp"])])
def test_partition_schemes_prune(spark, tmp_path, scheme, parts):
    days = spark.range(40).select(F.col("id"), F.date_add(F.lit("2024-01-20").cast("date"), F.col("id").cast("int")).alias("d"))
    none = F.lit(None).cast("string")
    flat = days.select(
        F.date_format("d", "yyyy-MM-dd'T'12:00:00'Z'").alias("eventtime"), F.lit("A").alias("eventname"), none.alias("eventsource"), none.alias("awsregion"), none.alias("sourceipaddress"), none.alias("useragent"), F.lit("1").alias("recipientaccountid"),
        none.alias("actor_type"), F.lit("u").alias("actor_arn"), none.alias("actor_username"), none.alias("mfa"), none.alias("errorcode"), none.alias("requestparameters"), F.col("id").alias("event_id"), F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), F.date_format("d", "yyyy/MM/dd").alias("timestamp"),
    )
    flat.write.partitionBy(*parts).parquet(str(tmp_path / scheme))
    got = sources.scan(spark.read.parquet(str(tmp_path / scheme)), sources.ADAPTERS["cloudtrail"], "2024-01-30T00:00:00Z", "2024-02-02T12:00:00Z", ("A",), scheme=scheme)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all(p in plan.split("PartitionFilters: ")[1].split("]")[0] for p in parts)
    assert sorted(r.event_time[:10] for r in got.select("event_time").collect()) == ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]


def test_package_lists_are_bounded_and_totals_whole(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("t"))
    row = package.package({"a": package.part(rows, [-F.col("id")], ["id", "t"], 3), "none": package.part(rows.limit(0), [F.col("id")], ["id"])}, {"stats": rows.agg(F.sum("id").alias("s"))}).first()
    assert (row.a.total, [i.id for i in row.a["items"]], row.none.total, row.none["items"], row.stats.s) == (1000, [999, 998, 997], 0, [], 499500)
    assert json.loads(package.package({"a": package.part(rows, [F.col("id")], ["id"], 2)}).select(F.to_json("a").alias("j")).first().j) == {"total": 1000, "items": [{"id": 0}, {"id": 1}]}


def test_chains_count_all_and_list_some(spark):
    e = spark.range(61).select(F.format_string("r%03d", "id").alias("row_id"), F.format_string("2026-01-01T00:00:%02dZ", F.least("id", F.lit(59))).alias("event_time"), F.when(F.col("id") == 0, "ConsoleLogin").otherwise("CreateUser").alias("event_name"), F.lit("1").alias("account"), F.lit("r").alias("region"), F.struct(F.lit("a").alias("arn"), F.lit(None).cast("string").alias("user_name"), F.lit(None).cast("string").alias("principal_id")).alias("actor"))
    e = e.withColumn("event_ts", F.try_to_timestamp("event_time"))
    (chain,) = correlate.escalation_chains(e, listed=5).collect()
    assert chain.escalation_count == 60 and [x.row_id for x in chain.escalation_events] == [f"r{i:03d}" for i in range(1, 6)]
    assert correlate.escalation_steps(e).count() == 60
