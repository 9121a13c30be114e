"""Persistence: calls that establish it, and the live state that shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.schema import actor_of, first_param

TARGETS = ("userName", "roleName", "policyArn", "functionName", "name", "instanceId", "keyName", "documentName", "ruleName")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(rules.SEVERITIES)], F.lit(len(rules.SEVERITIES)))


def looks_automated(actor: Column, agent: Column) -> Column:
    text = F.lower(F.concat_ws(" ", actor, F.coalesce(agent, F.lit(""))))
    return text.rlike("|".join(h.replace("-", r"\-") for h in rules.AUTOMATION_HINTS))


def url_of(technique: Column) -> Column:
    head, tail = rules.technique_url("|").split("|")
    return F.concat(F.lit(head), technique, F.lit(tail))


def mechanisms(spark: SparkSession) -> DataFrame:
    """(event_name, mechanism, technique, technique_name, base_severity, effect): one row for each event name."""
    rows = [(e, m, t, n, s, d) for m, (events, t, n, s, d) in rules.MECHANISMS.items() for e in events]
    return spark.createDataFrame(rows, "event_name string, mechanism string, technique string, technique_name string, base_severity string, effect string")


def hunt_events(events: DataFrame, suspects: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Persistence-establishing events; those that look automated count as low unless the actor is suspect.

    suspects: (actor); compared without case.  table: mechanisms, a row for each event name.
    """
    spark = events.sparkSession
    # the built-in table is small; of a given one Spark knows the size
    hit = events.join(table if table is not None else F.broadcast(mechanisms(spark)), "event_name").withColumn("actor_key", actor_of(principal=False))
    if suspects is None:
        hit = hit.withColumn("suspect", F.lit(False))
    else:
        known = suspects.select(F.lower("actor").alias("__actor")).distinct().withColumn("__hit", F.lit(True))
        hit = hit.join(known, F.lower("actor_key") == F.col("__actor"), "left").withColumn("suspect", F.coalesce("__hit", F.lit(False)))
    automated = looks_automated(F.col("actor_key"), F.col("user_agent"))
    target = first_param("request_params", TARGETS)
    return hit.select(
        "mechanism",
        "technique",
        "technique_name",
        url_of(F.col("technique")).alias("url"),
        F.when(automated & ~F.col("suspect"), "low").otherwise(F.col("base_severity")).alias("severity"),
        F.col("actor_key").alias("actor"),
        F.coalesce("account", F.lit("")).alias("account"),
        F.coalesce("region", F.lit("")).alias("region"),
        F.col("event_time").alias("time"),
        F.concat(F.concat_ws(" ", "event_name", "effect"), F.when(F.coalesce(target, F.lit("")) != "", F.concat(F.lit(" (target: "), target, F.lit(")"))).otherwise("")).alias("detail"),
        "event_name",
        target.alias("resource"),
        automated.alias("likely_automation"),
        F.lit("events").alias("source"),
    )


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, then time."""
    return findings.orderBy(severity_rank(F.col("severity")), F.coalesce("time", F.lit("")))


def persistence_summary(findings: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by mechanism and severity, of severe ones, and of likely automation."""
    each = F.array(
        F.struct(F.lit("mechanism").alias("dimension"), F.col("mechanism").alias("value")),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.when(F.col("severity").isin("critical", "high"), F.struct(F.lit("critical_or_high").alias("dimension"), F.lit("yes").alias("value"))),
        F.when(F.col("likely_automation"), F.struct(F.lit("likely_automation").alias("dimension"), F.lit("yes").alias("value"))),
    )
    return findings.select(F.explode(F.array_compact(each)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def _state(df: DataFrame, mechanism: str, technique: str, name: str, severity: Column, resource: Column, detail: Column, time: Column, region: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(mechanism).alias("mechanism"), F.lit(technique).alias("technique"), F.lit(name).alias("technique_name"), F.lit(rules.technique_url(technique)).alias("url"), severity.alias("severity"),
        F.lit("unknown").alias("actor"), F.col("account"), (region if region is not None else F.lit("global")).alias("region"), time.cast("string").alias("time"),
        detail.alias("detail"), F.lit("live_state").alias("event_name"), resource.alias("resource"), F.lit(False).alias("likely_automation"), F.lit("state").alias("source"),
    )


def recent_users(users: DataFrame, cutoff: str) -> DataFrame:
    """users: (account, user_name, create_date)."""
    return _state(users.filter(F.col("create_date") >= F.lit(cutoff).cast("timestamp")), "iam_backdoor", "T1136.003", "Create Account: Cloud Account", F.lit("high"), F.col("user_name"), F.concat(F.lit("IAM user created recently: "), F.col("user_name")), F.col("create_date"))


def many_keys(keys: DataFrame, most_users: int | None = None) -> DataFrame:
    """Users with more than one active key; ``most_users`` takes the first users of each account by name only.

    keys: (account, user_name, access_key_id, status).
    """
    count = keys.groupBy("account", "user_name").agg(F.count_if(F.col("status") == "Active").alias("active"))
    if most_users is not None:
        count = count.withColumn("nth", F.row_number().over(Window.partitionBy("account").orderBy("user_name"))).filter(F.col("nth") <= most_users)
    return _state(count.filter("active > 1"), "iam_backdoor", "T1098.001", "Account Manipulation: Additional Cloud Credentials", F.lit("high"), F.col("user_name"), F.concat(F.col("active"), F.lit(" active access keys")), F.lit(None))


def external_principals(policy: Column, own_account: Column) -> Column:
    """Sorted principals of Allow statements outside the account; ``*`` stands for everyone.

    A principal is the account's own where it contains the account id.
    """
    statements = F.from_json(policy, "struct<Statement:array<string>>")["Statement"]
    allowed = F.filter(F.coalesce(statements, F.array().cast("array<string>")), lambda s: F.get_json_object(s, "$.Effect") == "Allow")

    def names(s: Column) -> Column:
        whole, aws = F.get_json_object(s, "$.Principal"), F.get_json_object(s, "$.Principal.AWS")
        listed = F.when(aws.startswith("["), F.from_json(aws, "array<string>")).otherwise(F.array(aws))
        return F.when(whole == "*", F.array(F.lit("*"))).when(aws.isNotNull(), listed).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.transform(allowed, names))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: (p == "*") | ~p.contains(own_account))))


def external_trust(roles: DataFrame) -> DataFrame:
    """roles: (account, role_name, trust_policy JSON)."""
    found = roles.withColumn("outside", external_principals(F.col("trust_policy"), F.col("account"))).filter(F.size("outside") > 0)
    severity = F.when(F.array_contains("outside", "*"), "critical").otherwise("high")
    detail = F.concat(F.lit("role trusts external principal(s): "), F.array_join(F.slice("outside", 1, 5), ", "))
    return _state(found, "role_trust_modification", "T1098.003", "Account Manipulation: Additional Cloud Roles", severity, F.col("role_name"), detail, F.lit(None))


def recent_functions(functions: DataFrame, cutoff: str) -> DataFrame:
    """functions: (account, region, function_name, last_modified); unreadable times are passed over."""
    found = functions.withColumn("at", F.try_to_timestamp("last_modified")).filter(F.col("at") >= F.lit(cutoff).cast("timestamp"))
    return _state(found, "lambda_persistence", "T1546", "Event Triggered Execution", F.lit("medium"), F.col("function_name"), F.concat(F.lit("function modified recently: "), F.col("function_name")), F.col("last_modified"), F.col("region"))


def hunt_state(users: DataFrame, keys: DataFrame, roles: DataFrame, functions: DataFrame, cutoff: str) -> DataFrame:
    return recent_users(users, cutoff).union(many_keys(keys)).union(external_trust(roles)).union(recent_functions(functions, cutoff))


def principal_permissions(attached: DataFrame, kind: str, name: str) -> DataFrame:
    """Policies of one principal from a snapshot (kind, name, policy_arn, inline); none for a principal out of scope."""
    return attached.filter((F.col("kind") == kind) & (F.col("name") == name)).select("policy_arn", "inline")
