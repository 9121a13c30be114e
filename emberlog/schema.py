"""Canonical events: one row shape for every source, and who acted in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raw audit events as JSON. Free-form members stay JSON text, so that their keys keep their order.
RAW_EVENT = """
eventID string, eventTime string, eventName string, eventSource string, awsRegion string, sourceIPAddress string, userAgent string,
errorCode string, recipientAccountId string,
userIdentity struct<type:string,arn:string,userName:string,principalId:string,accountId:string,accessKeyId:string,
  sessionContext:struct<attributes:struct<mfaAuthenticated:string>>>,
requestParameters string, responseElements string, additionalEventData string
"""
EVENT = """
row_id string, event_time string, event_ts timestamp, event_name string, event_source string, region string, account string,
source_ip string, user_agent string, actor struct<type:string,arn:string,user_name:string,principal_id:string>,
access_key_id string, minted_key_id string, error_code string, request_params string, mfa_authenticated string,
repeat_count bigint, repeat_window array<string>
"""


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def actor_of(actor: str = "actor", principal: bool = True) -> Column:
    """ARN, else user name, else principal id (where asked for), else the empty text."""
    names = ["arn", "user_name", *(["principal_id"] if principal else [])]
    return filled(*[F.col(f"{actor}.{n}") for n in names])


def short_name(actor: Column) -> Column:
    """The last part of an ARN; ``unknown principal`` for none."""
    return F.when(actor.isin("", "unknown") | actor.isNull(), "unknown principal").otherwise(F.element_at(F.split(actor, "/"), -1))


def arn_parts(arn: Column) -> Column:
    """(kind, name): user, role or unknown."""
    kind = F.when(arn.contains(":user/"), "user").when(arn.contains(":assumed-role/") | arn.contains(":role/"), "role").otherwise("unknown")
    name = F.when(kind == "user", F.element_at(F.split(arn, "/"), -1)).when(kind == "role", F.get(F.split(F.regexp_extract(arn, r":(?:assumed-)?role/(.*)$", 1), "/"), F.lit(0))).otherwise(arn)
    return F.struct(kind.alias("kind"), name.alias("name"))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def first_param(params: str, names: tuple[str, ...], default: Column | None = None) -> Column:
    """The first of the named members that the JSON text has."""
    found = [F.get_json_object(params, f"$.{n}") for n in names]
    return F.coalesce(*found, *([default] if default is not None else []))


def canonical(raw: DataFrame, account: Column | None = None, region: Column | None = None) -> DataFrame:
    """Raw events in the canonical shape; secrets in responses are dropped but for the minted key's id."""
    user = "userIdentity"
    return raw.select(
        F.coalesce("eventID", F.sha2(F.to_json(F.struct("*")), 256)).alias("row_id"),
        F.col("eventTime").alias("event_time"),
        F.try_to_timestamp("eventTime").alias("event_ts"),
        F.col("eventName").alias("event_name"),
        F.col("eventSource").alias("event_source"),
        F.coalesce(F.nullif("awsRegion", F.lit("")), region if region is not None else F.lit(None)).alias("region"),
        F.coalesce(account if account is not None else F.lit(None).cast("string"), F.col("recipientAccountId")).alias("account"),
        F.col("sourceIPAddress").alias("source_ip"),
        truncated(F.col("userAgent"), 80).alias("user_agent"),
        F.struct(F.col(f"{user}.type").alias("type"), F.col(f"{user}.arn").alias("arn"), F.col(f"{user}.userName").alias("user_name"), F.col(f"{user}.principalId").alias("principal_id")).alias("actor"),
        F.nullif(F.col(f"{user}.accessKeyId"), F.lit("")).alias("access_key_id"),
        F.get_json_object("responseElements", "$.credentials.accessKeyId").alias("minted_key_id"),
        F.nullif("errorCode", F.lit("")).alias("error_code"),
        F.col("requestParameters").alias("request_params"),
        F.col(f"{user}.sessionContext.attributes.mfaAuthenticated").alias("mfa_authenticated"),
        F.lit(None).cast("bigint").alias("repeat_count"),
        F.lit(None).cast("array<string>").alias("repeat_window"),
    )
