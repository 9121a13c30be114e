"""Event sources in the canonical shape: JSON files, audit-log tables, OCSF tables and findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Audit events from JSON: one array to a file, or one event to a line."""
    return schema.canonical(spark.read.schema(schema.RAW_EVENT).option("multiLine", multi_line).json(path))


def parse_embedded(envelopes: DataFrame) -> DataFrame:
    """Events out of envelopes (event_json, event_name, account, region); unreadable JSON leaves the envelope's name."""
    e = envelopes.withColumn("e", F.from_json("event_json", schema.RAW_EVENT)).select("e.*", "event_name", "account", "region")
    e = e.withColumn("eventName", F.coalesce("eventName", "event_name"))
    return schema.canonical(e, account=F.col("account"), region=F.col("region"))


def _blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def from_table(rows: DataFrame) -> DataFrame:
    """Rows of an audit-log table with flat columns; keys are taken over where the table has them."""
    has = lambda c: _blank(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.sha2(F.to_json(F.struct("*")), 256).alias("row_id"), _blank("eventtime").alias("event_time"), F.try_to_timestamp("eventtime").alias("event_ts"), _blank("eventname").alias("event_name"),
        _blank("eventsource").alias("event_source"), _blank("awsregion").alias("region"), _blank("recipientaccountid").alias("account"), _blank("sourceipaddress").alias("source_ip"),
        schema.truncated(_blank("useragent"), 80).alias("user_agent"),
        F.struct(_blank("actor_type").alias("type"), _blank("actor_arn").alias("arn"), _blank("actor_username").alias("user_name"), F.lit(None).cast("string").alias("principal_id")).alias("actor"),
        has("accesskeyid").alias("access_key_id"), has("minted_key_id").alias("minted_key_id"), _blank("errorcode").alias("error_code"), _blank("requestparameters").alias("request_params"),
        _blank("mfa").alias("mfa_authenticated"), F.lit(None).cast("bigint").alias("repeat_count"), F.lit(None).cast("array<string>").alias("repeat_window"),
    )


def from_ocsf(rows: DataFrame) -> DataFrame:
    """Rows of an OCSF table: renamed columns, no request parameters."""
    none = F.lit(None).cast("string")
    return rows.select(
        F.sha2(F.to_json(F.struct("*")), 256).alias("row_id"), F.date_format("time_dt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"), F.col("time_dt").cast("timestamp").alias("event_ts"),
        F.col("api.operation").alias("event_name"), F.col("api.service.name").alias("event_source"), "region", F.col("cloud.account.uid").alias("account"), F.col("src_endpoint.ip").alias("source_ip"),
        schema.truncated(F.col("http_request.user_agent"), 80).alias("user_agent"),
        F.struct(F.col("actor.user.type").alias("type"), F.col("actor.user.uid").alias("arn"), F.col("actor.user.name").alias("user_name"), none.alias("principal_id")).alias("actor"),
        none.alias("access_key_id"), none.alias("minted_key_id"), F.col("status_code").alias("error_code"), none.alias("request_params"), F.col("mfa").cast("string").alias("mfa_authenticated"),
        F.lit(None).cast("bigint").alias("repeat_count"), F.lit(None).cast("array<string>").alias("repeat_window"),
    )


def partition_filter(start: str, end: str, scheme: str) -> Column:
    """A predicate on partition columns: ``ymd`` (year, month, day), ``timestamp`` (text with slashes), else none."""
    if scheme == "ymd":
        day = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
        return day.between(start[:10], end[:10])
    if scheme == "timestamp":
        return F.col("timestamp").between(start[:10].replace("-", "/"), end[:10].replace("-", "/"))
    return F.lit(True)


def scan(table: DataFrame, adapter: Callable[[DataFrame], DataFrame], start: str, end: str, names: Sequence[str], accounts: Sequence[str] = (), regions: Sequence[str] = (), actors: Sequence[str] = (), row_cap: int | None = None, scheme: str = "none") -> DataFrame:
    """A bounded scan: partitions, times (both ends included), names, accounts, regions, parts of actors; with a cap the oldest rows."""
    e = adapter(table.filter(partition_filter(start, end, scheme)))
    e = e.filter(F.col("event_time").between(start, end) & F.col("event_name").isin(*names))
    for column, values in (("account", accounts), ("region", regions)):
        if values:
            e = e.filter(F.col(column).isin(*values))
    if actors:
        hit = F.lit(False)
        for a in actors:
            hit = hit | schema.actor_of().contains(a)
        e = e.filter(hit)
    return e if row_cap is None else e.orderBy("event_time", "row_id").limit(row_cap)


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"cloudtrail": from_table, "security_lake": from_ocsf, "canonical": lambda df: df}

FINDING = """
Id string, Type string, Severity double, Title string, Description string, AccountId string, Region string,
Resource struct<AccessKeyDetails:struct<UserName:string,PrincipalId:string>>,
Service struct<Action:string,Detection:struct<Sequence:struct<Signals:array<string>,Actors:array<struct<Id:string>>>>>
"""


def read_findings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Findings from JSON in either letter case: (finding_id, type, severity, title, description, account, region, user_name, principal_id, ips, action, signals, actors).

    """
    if multi_line:
        raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<string>")).alias("j"))
    else:
        raw = spark.read.text(path).select(F.col("value").alias("j"))
    return parse_findings(raw)


def parse_findings(raw: DataFrame) -> DataFrame:
    """The same out of JSON texts (j), with account and region of the row, if it has them, where the finding names none.

    Spark matches JSON members by exact name, so both spellings are read and the one there is is taken.
    """
    lower = FINDING
    for name in ("Id", "Type", "Severity", "Title", "Description", "AccountId", "Region", "Resource", "Service", "AccessKeyDetails", "UserName", "PrincipalId", "Action", "Detection", "Sequence", "Signals", "Actors"):
        lower = lower.replace(f"{name} ", f"{name[0].lower()}{name[1:]} ").replace(f"{name}:", f"{name[0].lower()}{name[1:]}:")
    place = [c for c in ("account", "region") if c in raw.columns]
    f = raw.select(F.from_json("j", FINDING).alias("u"), F.from_json("j", lower).alias("l"), *place)
    given = lambda c: F.col(c) if c in place else F.lit(None).cast("string")
    both = lambda p: F.coalesce(F.col("u." + p), F.col("l." + ".".join(x[0].lower() + x[1:] for x in p.split("."))))
    action = both("Service.Action")
    return f.select(
        both("Id").alias("finding_id"), both("Type").alias("type"), both("Severity").alias("severity"), both("Title").alias("title"), both("Description").alias("description"),
        F.coalesce(both("AccountId"), given("account")).alias("account"), F.coalesce(both("Region"), given("region")).alias("region"), both("Resource.AccessKeyDetails.UserName").alias("user_name"), both("Resource.AccessKeyDetails.PrincipalId").alias("principal_id"),
        F.array_distinct(F.regexp_extract_all(F.coalesce(action, F.lit("")), F.lit(r'"[iI]pAddressV4"\s*:\s*"([0-9.]+)"'), F.lit(1))).alias("ips"), action.alias("action"),
        both("Service.Detection.Sequence.Signals").alias("signals"), F.transform(F.coalesce(F.col("u.Service.Detection.Sequence.Actors.Id"), F.col("l.service.detection.sequence.actors.id")), lambda i: F.struct(i.alias("id"))).alias("actors"),
    )
