"""Read-only tools over evidence as SQL table functions with parameters.

``register`` makes temporary views and functions; a tool is then called from SQL, ``SELECT * FROM query_events(array('StopLogging'), '', '', '')``, and Spark plans its body like any
other query, with filters pushed down.  ``call`` takes a tool by name with its arguments and gives its result as JSON of bounded length; an unknown tool is a row with an error.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import scoring
from emberlog.schema import filled

# How many rows a tool lists, and how many characters of a result are passed on.
TIMELINE_ROWS, EVENT_ROWS, RESULT_LIMIT, ERROR_LIMIT = 60, 50, 12_000, 300

_BRIEF = "event_time STRING, event_name STRING, actor STRING, source_ip STRING, account STRING, region STRING, error_code STRING, mfa STRING"
_COLUMNS = "event_time, event_name, actor, source_ip, account, region, error_code, mfa"

#: name: (parameters, columns, body)
TOOLS: dict[str, tuple[str, str, str]] = {
    "get_actor_timeline": (
        "actor_part STRING",
        f"event_count BIGINT, {_BRIEF}",
        f"""SELECT event_count, {_COLUMNS} FROM (SELECT t.*, row_id FROM (SELECT {_COLUMNS}, row_id FROM tool_events WHERE get_actor_timeline.actor_part <> '' AND contains(actor, get_actor_timeline.actor_part) ORDER BY event_time, row_id LIMIT {TIMELINE_ROWS}) t)
        CROSS JOIN (SELECT count(*) AS event_count FROM tool_events WHERE get_actor_timeline.actor_part <> '' AND contains(actor, get_actor_timeline.actor_part)) ORDER BY event_time, row_id""",
    ),
    "query_events": (
        "event_names ARRAY<STRING>, actor_contains STRING, after STRING, before STRING",
        _BRIEF,
        f"""SELECT {_COLUMNS} FROM tool_events WHERE (coalesce(size(query_events.event_names), 0) <= 0 OR array_contains(query_events.event_names, event_name)) AND contains(actor, coalesce(query_events.actor_contains, ''))
        AND (coalesce(query_events.after, '') = '' OR event_time >= query_events.after) AND (coalesce(query_events.before, '') = '' OR event_time <= query_events.before) ORDER BY event_time, row_id LIMIT {EVENT_ROWS}""",
    ),
    "get_session_detail": (
        "session_key STRING",
        "key STRING, assumed_by STRING, assumed_at STRING, action_count BIGINT, actions ARRAY<STRING>, notable ARRAY<STRING>",
        "SELECT key, assumed_by, assumed_at, action_count, actions, notable FROM tool_sessions WHERE startswith(key, substr(get_session_detail.session_key, 1, 8)) ORDER BY key LIMIT 1",
    ),
    "check_principal_permissions": (
        "principal_arn STRING",
        "kind STRING, name STRING, attached ARRAY<STRING>, inline ARRAY<STRING>, groups ARRAY<STRING>",
        """SELECT any_value(kind), any_value(name), array_sort(collect_set(CASE WHEN source = 'attached' THEN policy END)), array_sort(collect_set(CASE WHEN source = 'inline' THEN policy END)), array_sort(collect_set(CASE WHEN source = 'group' THEN policy END))
        FROM tool_policies WHERE account = split_part(check_principal_permissions.principal_arn, ':', 5)
          AND kind = CASE WHEN contains(check_principal_permissions.principal_arn, ':user/') THEN 'user' WHEN rlike(check_principal_permissions.principal_arn, ':(assumed-)?role/') THEN 'role' END
          AND name = CASE WHEN contains(check_principal_permissions.principal_arn, ':assumed-role/') THEN split_part(check_principal_permissions.principal_arn, '/', 2)
            ELSE regexp_extract(check_principal_permissions.principal_arn, ':(?:user|role)/(.*)$', 1) END
        HAVING count(*) > 0""",
    ),
    "lookup_indicator": (
        "indicator STRING",
        "matched BOOLEAN, confidence INT, group_ids ARRAY<STRING>, categories ARRAY<STRING>, feeds ARRAY<STRING>",
        """SELECT count(*) > 0, max(confidence), array_sort(collect_set(group_id)), array_sort(collect_set(category)), array_sort(collect_set(feed)) FROM tool_feed WHERE value = lower(lookup_indicator.indicator)""",
    ),
    "resolve_blind_spot": (
        "blind_spot STRING",
        "step INT, score DOUBLE, priority STRING",
        "SELECT step, score, priority FROM tool_rescored WHERE spot = lower(trim(resolve_blind_spot.blind_spot))",
    ),
}


def rescored(steps: DataFrame) -> DataFrame:
    """(spot, step, score, priority): the steps as they score once a blind spot that they name is resolved, for every blind spot."""
    spots = F.array_distinct(F.transform("evidence_quality.blind_spots", lambda s: F.lower(F.trim(s))))
    each = steps.withColumn("spot", F.explode(spots))
    left = F.filter("evidence_quality.blind_spots", lambda s: F.lower(F.trim(s)) != F.col("spot"))
    scored = scoring.score_steps(each.withColumn("evidence_quality", F.col("evidence_quality").withField("blind_spots", left)))
    return scored.select("spot", "step", "score", "priority")


def register(spark: SparkSession, events: DataFrame, sessions: DataFrame, policies: DataFrame, feed: DataFrame, steps: DataFrame) -> None:
    """Makes the tools of a session over its evidence.

    policies: (account, kind, name, source, policy) with source attached, inline or group; the others as their operators give them.
    """
    who = filled(F.col("actor.arn"), F.col("actor.user_name"))
    events.select("row_id", "event_time", "event_name", who.alias("actor"), "source_ip", "account", "region", "error_code", F.col("mfa_authenticated").alias("mfa")).createOrReplaceTempView("tool_events")
    sessions.withColumn("actions", F.transform("actions", lambda a: a["event"])).createOrReplaceTempView("tool_sessions")
    policies.createOrReplaceTempView("tool_policies")
    feed.createOrReplaceTempView("tool_feed")
    rescored(steps).createOrReplaceTempView("tool_rescored")
    for name, (parameters, columns, body) in TOOLS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")


def _literal(value: object, kind: str) -> str:
    if kind.startswith("ARRAY"):
        return f"CAST(from_json({_literal(json.dumps(value or []), 'STRING')}, 'array<string>') AS ARRAY<STRING>)"
    quote, backslash = chr(39), chr(92)
    text = "" if value is None else str(value)
    return quote + text.replace(backslash, backslash * 2).replace(quote, backslash + quote) + quote


def call(spark: SparkSession, tool: str, arguments: Mapping[str, object]) -> DataFrame:
    """(tool, n, result, error): the result's rows as one JSON text of bounded length; error for an unknown tool or argument."""
    schema = "tool string, n bigint, result string, error string"
    if tool not in TOOLS:
        return spark.createDataFrame([(tool, 0, None, f"unknown tool {tool}"[:ERROR_LIMIT])], schema)
    parameters = [p.strip().split(" ", 1) for p in TOOLS[tool][0].split(",")]
    strange = sorted(set(arguments) - {n for n, _ in parameters})
    if strange:
        return spark.createDataFrame([(tool, 0, None, f"unknown argument {strange[0]}"[:ERROR_LIMIT])], schema)
    rows = spark.sql(f"SELECT * FROM {tool}({', '.join(_literal(arguments.get(n), kind) for n, kind in parameters)})")
    # tools list a bounded number of rows
    listed = rows.agg(F.count("*").alias("n"), F.to_json(F.collect_list(F.struct("*"))).alias("all"))
    none = F.when((F.col("n") == 0) & F.lit(tool == "get_session_detail"), "session not found").when((F.col("n") == 0) & F.lit(tool == "check_principal_permissions"), "principal not in scope")
    return listed.select(F.lit(tool).alias("tool"), "n", F.substring("all", 1, RESULT_LIMIT).alias("result"), none.alias("error"))
