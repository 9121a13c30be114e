"""Readiness of accounts and regions for an investigation, and the estate's summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.rules import READINESS as R


def work_list(targets: DataFrame, regions: Sequence[str]) -> DataFrame:
    """(account, region): each target with its own regions, or else the given ones.  targets: (account, regions)."""
    own = F.when(F.size("regions") > 0, F.col("regions")).otherwise(F.array(*[F.lit(r) for r in regions]))
    return targets.select("account", F.explode(own).alias("region"))


def active_accounts(accounts: DataFrame, include_suspended: bool = False) -> DataFrame:
    return accounts if include_suspended else accounts.filter("status = 'ACTIVE'")


def role_arn(account: Column, role: str, partition: str = "aws") -> Column:
    return F.format_string(f"arn:{partition}:iam::%s:role/{role}", account)


def error_kind(message: Column) -> Column:
    """access_denied, not_found, throttled or other, of an error code."""
    return F.when(message.contains("AccessDenied"), "access_denied").when(message.rlike("NoSuchEntity|NotFound"), "not_found").when(message.contains("Throttl"), "throttled").when(message.isNotNull(), "other")


def snapshot(work: DataFrame, trails: DataFrame, detectors: DataFrame, recorders: DataFrame, flow_logs: DataFrame, hubs: DataFrame, failures: DataFrame) -> DataFrame:
    """One row for each account and region of the work list, reachable or not."""
    key = ["account", "region"]
    trail = F.struct("name", "is_multi_region", "is_logging", "has_log_file_validation", "data_events_configured")
    t = trails.groupBy(*key).agg(F.array_sort(F.collect_list(trail)).alias("trails"))
    flag = lambda df, n: df.select(*key).distinct().withColumn(n, F.lit(True))
    flows = flow_logs.groupBy(*key).agg(F.count("*").alias("vpc_flow_logs_count"))
    out = work.join(t, key, "left").join(flag(detectors, "guardduty_enabled"), key, "left").join(flag(recorders, "config_recording"), key, "left")
    out = out.join(flows, key, "left").join(flag(hubs, "securityhub_enabled"), key, "left").join(failures.select(*key, "error"), key, "left")
    return out.withColumn("reachable", F.col("error").isNull()).na.fill(False, ["guardduty_enabled", "config_recording", "securityhub_enabled"]).na.fill(0, ["vpc_flow_logs_count"])


def band(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 60, "adequate").when(score >= 35, "degraded").otherwise("severely_limited")


def readiness(regions: DataFrame) -> DataFrame:
    """Adds score, band, gaps and strengths; where nothing could be read the score is 0 and the band no_access."""
    trails = F.coalesce("trails", F.array().cast(regions.schema["trails"].dataType))
    active = F.filter(trails, lambda t: t["is_logging"])
    some = F.size(active) > 0
    has = lambda f: some & F.exists(active, lambda t: t[f])
    multi, valid, data = has("is_multi_region"), has("has_log_file_validation"), has("data_events_configured")
    guard, config, flows, hub = F.col("guardduty_enabled"), F.col("config_recording"), F.col("vpc_flow_logs_count") > 0, F.col("securityhub_enabled")
    points = lambda cond, n: F.when(cond, F.lit(R[n])).otherwise(0)
    score = sum((points(c, n) for c, n in ((some, "trail"), (multi, "multi_region"), (valid, "validation"), (data, "data_events"), (guard, "guardduty"), (config, "config"), (flows, "flow_logs"), (hub, "hub"))), F.lit(0)).cast("double")
    # The texts of gaps and strengths.
    gaps = F.array_compact(
        F.array(
            F.when(some & ~multi, "No multi-region CloudTrail: activity in unmonitored regions is invisible"),
            F.when(some & ~valid, "Log file validation off: log integrity cannot be proven for evidentiary use"),
            F.when(some & ~data, "No S3/Lambda data events: object-level access and exfiltration are not recorded"),
            F.when(~some, "CRITICAL: no active CloudTrail trail. Control-plane activity is not being recorded."),
            F.when(~some & (F.size(trails) > 0), F.concat(F.size(trails), F.lit(" trail(s) exist but are not logging: check for deliberate StopLogging"))),
            F.when(~guard, "GuardDuty disabled: no managed threat detection or attack-sequence correlation"),
            F.when(~config, "AWS Config not recording: resource configuration history unavailable for timeline reconstruction"),
            F.when(~flows, "No VPC flow logs: lateral movement and exfiltration volume cannot be corroborated"),
        )
    )
    strengths = F.array_compact(
        F.array(
            F.when(some, F.concat(F.size(active), F.lit(" active CloudTrail trail(s)"))),
            F.when(guard, "GuardDuty enabled"),
            F.when(config, "AWS Config recording"),
            F.when(flows, F.concat(F.col("vpc_flow_logs_count"), F.lit(" VPC flow log(s)"))),
        )
    )
    here = F.col("reachable")
    none = F.array().cast("array<string>")
    return regions.withColumns(
        {
            "readiness_score": F.when(here, score).otherwise(0.0),
            "readiness_band": F.when(here, band(score)).otherwise("no_access"),
            "gaps": F.when(here, gaps).otherwise(none),
            "strengths": F.when(here, strengths).otherwise(none),
        }
    )


def estate_summary(scored: DataFrame) -> DataFrame:
    """One row; the mean is over reachable regions."""
    place = F.concat_ws(":", "account", "region")
    here = F.col("reachable")
    dark = here & ~F.exists(F.coalesce("trails", F.array().cast(scored.schema["trails"].dataType)), lambda t: t["is_logging"])
    where = lambda cond: F.array_sort(F.collect_set(F.when(cond, place)))
    return scored.agg(
        F.count("*").alias("total_regions"), F.count_if(here).alias("reachable"), F.round(F.coalesce(F.avg(F.when(here, F.col("readiness_score"))), F.lit(0.0)), 1).alias("mean_readiness"),
        where(dark).alias("without_cloudtrail"), where(here & ~F.col("guardduty_enabled")).alias("without_guardduty"),
    )


def gap_frequency(scored: DataFrame) -> DataFrame:
    """(gap, n): gaps by the text before the first colon, the most frequent first."""
    return scored.select(F.explode("gaps").alias("gap")).groupBy(F.substring_index("gap", ":", 1).alias("gap")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap")
