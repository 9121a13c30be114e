"""Correlation of canonical events: timelines, gaps, pivots, chains, sessions, patterns, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions.dates import minutes_between
from emberlog.functions.shared import placed, stored
from emberlog.operators import profiles
from emberlog.schema import actor_of, first_param, truncated

TIME = "event_time"
ORDER = (TIME, "row_id")


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))


def timelines(events: DataFrame, phases: dict[str, tuple[str, ...]] = rules.PHASES, weight: str = "rows", listed: int = profiles.LISTED) -> DataFrame:
    """One row for each actor; ``weight="repeat"`` counts collapsed events as often as they occurred.

    Accounts, regions and addresses are the first ``listed`` in order, with the number of all; ``profiles.actor_values`` has them all as rows.
    """
    name = F.col("event_name")
    phase = F.array_sort(F.array_compact(F.array(*[F.max(F.when(name.isin(*names), F.lit(p))) for p, names in phases.items()])))
    times = F.coalesce("repeat_count", F.lit(1)) if weight == "repeat" else F.lit(1)
    about = (
        events.withColumn("actor_key", actor_of())
        .filter("actor_key <> ''")
        .groupBy(F.col("actor_key").alias("actor"))
        .agg(
            F.sum(times).cast("bigint").alias("event_count"),
            F.min(F.nullif(TIME, F.lit(""))).alias("first_seen"),
            F.max(F.nullif(TIME, F.lit(""))).alias("last_seen"),
            phase.alias("phases"),
            F.count_if(F.lower("mfa_authenticated") == "false").alias("mfa_absent_events"),
        )
    )
    names = {"account": ("accounts", "account_count"), "region": ("regions", "region_count"), "source_ip": ("source_ips", "source_ip_count")}
    lists = profiles.wide(profiles.bounded_lists(profiles.actor_values(events), listed), names)
    none = F.array().cast("array<string>")
    filled_in = {c: F.coalesce(c, none) for c, _ in names.values()} | {n: F.coalesce(n, F.lit(0)) for _, n in names.values()}
    return about.join(lists, "actor", "left").withColumns(filled_in).withColumn("cross_account", F.col("account_count") > 1)


def gap_resource() -> Column:
    return first_param("request_params", ("name", "trailName", "flowLogIds", "detectorId", "configurationRecorderName"), F.lit("unknown"))


def logging_gaps(events: DataFrame, disable: Sequence[str] = rules.DISABLE, enable: Sequence[str] = rules.ENABLE, resource: Column | None = None) -> DataFrame:
    """Windows between a disabling event and the next enabling one of the same account, region and resource.

    A later disabling event replaces an earlier one; a window without an end stays open.  ``events_during_gap`` counts
    all events strictly inside a closed window, whoever caused them; none, if one of its ends has no time.

    Events are read once.  All get their place in order of time, of equal times the enabling ones first and the disabling ones last, so that the first place of the enabling events of a
    time is the number of events before it, and the last place of the disabling ones that of the events up to it.  Only these events are paired.
    """
    name = F.col("event_name")
    side = F.when(name.isin(*enable), 0).when(name.isin(*disable), 2).otherwise(1)
    turn = F.struct("event_ts", "event_name", (resource if resource is not None else gap_resource()).alias("resource"), F.coalesce("account", F.lit("")).alias("account"), F.coalesce("region", F.lit("")).alias("region"), actor_of().alias("disabled_by"))
    rows = events.select(TIME, side.alias("side"), "row_id", F.when(side != 1, turn).alias("turn"))
    turns = placed(rows, TIME, "side", "row_id").filter("side <> 1").select(TIME, "side", "row_id", "place", "turn.*")
    edges = turns.groupBy(TIME).agg(F.min(F.when(F.col("side") == 0, F.col("place"))).alias("before"), (F.max(F.when(F.col("side") == 2, F.col("place"))) + 1).alias("upto"))
    turns = turns.drop("place").join(edges, TIME, "left")  # a time that is null has no edges
    w = Window.partitionBy("account", "region", "resource").orderBy(F.coalesce(TIME, F.lit("")), "row_id")
    nxt = lambda c: F.lead(c).over(w)
    pairs = turns.withColumns({"next_name": nxt("event_name"), "end": nxt(TIME), "end_ts": nxt("event_ts"), "end_before": nxt("before")}).filter(name.isin(*disable))
    pairs = pairs.filter(F.col("next_name").isNull() | F.col("next_name").isin(*enable))
    return pairs.select(
        F.col(TIME).alias("start"),
        "end",
        minutes_between(F.col("event_ts"), F.col("end_ts")).alias("duration_minutes"),
        "disabled_by",
        F.col("event_name").alias("disable_event"),
        "resource",
        "account",
        "region",
        F.col("next_name").isNull().alias("still_open"),
        F.when(F.col("next_name").isNull(), F.lit(0)).otherwise(F.greatest(F.coalesce(F.col("end_before") - F.col("upto"), F.lit(0)), F.lit(0))).cast("bigint").alias("events_during_gap"),
    )


def pivots(events: DataFrame) -> DataFrame:
    """Role assumptions into another account."""
    role = F.get_json_object("request_params", "$.roleArn")
    target = F.get(F.split(role, ":"), F.lit(4))
    return events.filter((F.col("event_name") == "AssumeRole") & (target != "") & (F.col("account") != "") & (target != F.col("account"))).select(
        F.col(TIME).alias("time"), actor_of().alias("actor"), F.col("account").alias("source_account"), target.alias("target_account"), role.alias("target_role"), "source_ip"
    )


def followers(events: DataFrame, access: Sequence[str] = rules.ACCESS, escalation: Sequence[str] = rules.ESCALATION, minutes: int = 15) -> DataFrame:
    """(access event, escalation event) of one actor, the second after the first and within the window.

    The band join runs on buckets as long as the window: an event meets its own bucket and the next, so an actor
    with very many events is dealt over its buckets.  A row without a readable time between the two ends the search: ``torn`` numbers the stretches
    between such rows, counted within each hour of an actor, with the hours' own sums added.
    """
    name, unread = F.col("event_name"), F.col("event_ts").isNull()
    rows = events.withColumn("actor_key", actor_of()).filter((F.col("actor_key") != "") & (name.isin(*access, *escalation) | unread))
    rows = rows.select("actor_key", TIME, "row_id", "event_name", "account", "region", "event_ts", F.substring(F.coalesce(TIME, F.lit("")), 1, 13).alias("hour"))
    hours = rows.groupBy("actor_key", "hour").agg(F.count_if(unread).alias("n"))
    ahead = Window.partitionBy("actor_key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = F.count_if(unread).over(Window.partitionBy("actor_key", "hour").orderBy(F.coalesce(TIME, F.lit("")), "row_id"))
    rows = rows.withColumn("within", within).filter(~unread).join(hours, ["actor_key", "hour"]).withColumn("torn", F.col("ahead") + F.col("within"))
    micros = minutes * 60_000_000
    rows = rows.select("actor_key", "torn", TIME, "row_id", "event_name", "account", "region", F.unix_micros("event_ts").alias("at")).withColumn("bucket", F.floor(F.col("at") / micros))
    side = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a = side(rows.filter(name.isin(*access)), "a").withColumn("bucket", F.explode(F.array(F.col("a_bucket"), F.col("a_bucket") + 1)))
    b = side(rows.filter(name.isin(*escalation)), "b")
    later = (F.struct(f"b_{TIME}", "b_row_id") > F.struct(f"a_{TIME}", "a_row_id")) & (F.col("b_at") - F.col("a_at") <= micros)
    return a.join(b, (F.col("a_actor_key") == F.col("b_actor_key")) & (F.col("bucket") == F.col("b_bucket")) & (F.col("a_torn") == F.col("b_torn")) & later)


def escalation_steps(events: DataFrame, access: Sequence[str] = rules.ACCESS, escalation: Sequence[str] = rules.ESCALATION, minutes: int = 15) -> DataFrame:
    """(actor, access_row, access_time, access_event, time, row_id, event, account, region): a row for each escalation event after each access event, however many."""
    return followers(events, access, escalation, minutes).select(
        F.col("a_actor_key").alias("actor"), F.col("a_row_id").alias("access_row"), F.col(f"a_{TIME}").alias("access_time"), F.col("a_event_name").alias("access_event"),
        F.col(f"b_{TIME}").alias("time"), F.col("b_row_id").alias("row_id"), F.col("b_event_name").alias("event"), F.col("b_account").alias("account"), F.col("b_region").alias("region"),
    )


def escalation_chains(events: DataFrame, access: Sequence[str] = rules.ACCESS, escalation: Sequence[str] = rules.ESCALATION, minutes: int = 15, listed: int = 100) -> DataFrame:
    """One row for each access event that an escalation event follows in time: how many do, and the first ``listed`` of them."""
    steps = stored(escalation_steps(events, access, escalation, minutes), "escalation-steps")
    key = ["actor", "access_row"]
    about = steps.groupBy(*key).agg(F.first("access_time").alias("access_time"), F.first("access_event").alias("access_event"), F.count("*").alias("escalation_count"), F.lit(minutes).alias("window_minutes"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("time", "row_id"))  # tasks send on so many of each
    first = steps.withColumn("nth", nth).filter(F.col("nth") <= listed).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("time", "row_id", "event", "account", "region"))).alias("escalation_events"))
    return about.join(first, key)


def session_chains(events: DataFrame, after_mint_only: bool = False, listed: int = 25, keep: bool = True) -> DataFrame:
    """Minted session keys with what was done under them; keys without actions stay.

    The last event that minted a key is its origin.  ``after_mint_only`` leaves out actions before it.  Events under minted keys meet their origin in one join, whose
    rows alone are kept for the counts and the first actions; without ``keep`` nothing is written or run here, which serves filters by key and uses of the counts alone.
    """
    mint = events.filter(F.col("event_name").isin(*rules.MINTING) & (F.coalesce("minted_key_id", F.lit("")) != ""))
    origin = mint.groupBy(F.col("minted_key_id").alias("key")).agg(
        F.max(F.struct(TIME, F.col("row_id").alias("mint_row"), actor_of().alias("assumed_by"), F.col(TIME).alias("assumed_at"), F.get_json_object("request_params", "$.roleArn").alias("role"), "source_ip")).alias("o")
    ).select("key", "o.*").drop(TIME)
    done = events.filter(F.col("access_key_id").isNotNull()).select(F.col("access_key_id").alias("key"), "row_id", F.col(TIME).alias("time"), F.col("event_name").alias("event"), "account", "region")
    joined = origin.join(done, "key", "left").withColumn("own", F.col("row_id").isNotNull() & (F.col("row_id") != F.col("mint_row")))
    if after_mint_only:
        joined = joined.withColumn("own", F.col("own") & (F.col("time") >= F.col("assumed_at")))
    joined = stored(joined, "sessions") if keep else joined
    notable = F.col("event").isin(*rules.ESCALATION, *rules.DISABLE, *rules.EXFILTRATION)
    own = F.col("own")
    about = joined.groupBy("key", "assumed_by", "assumed_at", "role", "source_ip").agg(F.count_if(own).alias("action_count"), F.array_sort(F.collect_set(F.when(own & notable, F.col("event")))).alias("notable"))
    # the first ones of each key by rank: tasks send no more than those on, and no list grows with a session
    rank = F.row_number().over(Window.partitionBy("key").orderBy("time", "row_id"))
    first = joined.filter(own).select("key", "time", "row_id", "event", "account", "region").withColumn("rank", rank).filter(F.col("rank") <= listed)
    first = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("time", "row_id", "event", "account", "region"))).alias("actions"))
    out = about.join(first, "key", "left").withColumn("actions", F.coalesce("actions", F.array().cast(first.schema["actions"].dataType)))
    return out.withColumn("session_key", F.when(F.length("key") > 8, F.concat(F.substring("key", 1, 8), F.lit("..."))).otherwise(F.col("key")))


def attack_patterns(events: DataFrame, weight: str = "rows") -> DataFrame:
    """Rows for the rules that an actor's counts fulfil; one aggregation counts for all rules."""
    name, times = F.col("event_name"), F.coalesce("repeat_count", F.lit(1)) if weight == "repeat" else F.lit(1)
    total = lambda cond: F.sum(F.when(cond, times).otherwise(0)).cast("bigint")
    counts = events.withColumn("actor_key", actor_of()).filter("actor_key <> ''").groupBy(F.col("actor_key").alias("actor")).agg(
        F.count("*").alias("event_count"), F.min(TIME).alias("first_seen"), F.max(TIME).alias("last_seen"), _sorted_set(F.col("account")).alias("accounts"),
        F.count_distinct(F.nullif("region", F.lit(""))).alias("regions"),
        total(name == "RunInstances").alias("runs"),
        total(name.isin("DeleteObject", "DeleteObjects")).alias("deletes"),
        total(name.isin("PutBucketLifecycle", "PutBucketLifecycleConfiguration", "PutBucketVersioning", "DeleteBucketPolicy")).alias("tamper"),
        total(name.isin("ModifySnapshotAttribute", "ModifyDBSnapshotAttribute", "ModifyImageAttribute", "ModifyDBClusterSnapshotAttribute")).alias("shares"),
        total(name.rlike("^(List|Describe|GetAccount)")).alias("listing"),
        total(name.isin("GetSecretValue", "BatchGetSecretValue", "GetParameter", "GetParameters", "GetParametersByPath", "Decrypt")).alias("secrets"),
        total(name.isin("PutBucketAcl", "PutBucketPolicy", "PutObjectAcl", "AuthorizeSecurityGroupIngress", "ModifyDBInstance")).alias("exposed"),
    )
    c = F.col
    # Names, thresholds, techniques and texts of the rules.
    found = [
        ("cryptomining_indicator", c("runs") >= 3, "T1496", "Resource Hijacking", F.when((c("runs") >= 10) | (c("regions") >= 3), "high").otherwise("medium"), F.concat(c("runs"), F.lit(" RunInstances across "), c("regions"), F.lit(" region(s)"))),
        ("s3_ransomware_indicator", (c("deletes") >= 20) | ((c("tamper") > 0) & (c("deletes") > 0)), "T1485", "Data Destruction", F.lit("critical"), F.concat(c("deletes"), F.lit(" delete calls, "), c("tamper"), F.lit(" lifecycle/versioning changes"))),
        ("snapshot_exfiltration", c("shares") > 0, "T1537", "Transfer Data to Cloud Account", F.lit("high"), F.concat(c("shares"), F.lit(" snapshot/image sharing change(s)"))),
        ("discovery_burst", c("listing") >= 30, "T1580", "Cloud Infrastructure Discovery", F.lit("medium"), F.concat(c("listing"), F.lit(" enumeration calls"))),
        ("secrets_harvesting", c("secrets") >= 5, "T1552.005", "Unsecured Credentials: Cloud Instance Metadata API", F.lit("high"), F.concat(c("secrets"), F.lit(" secret/parameter retrievals"))),
        ("resource_exposure", c("exposed") >= 3, "T1562.007", "Impair Defenses: Disable or Modify Cloud Firewall", F.lit("high"), F.concat(c("exposed"), F.lit(" exposure-related change(s)"))),
    ]
    rows = [F.when(cond, F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("technique"), F.lit(tn).alias("technique_name"), F.lit(rules.technique_url(t)).alias("url"), s.alias("severity"), d.alias("detail"))) for p, cond, t, tn, s, d in found]
    return counts.withColumn("p", F.explode(F.array_compact(F.array(*rows)))).select("p.*", "actor", "first_seen", "last_seen", "event_count", "accounts")


def link_findings(findings: DataFrame, lines: DataFrame, by_short_name: bool = False, addresses: DataFrame | None = None) -> DataFrame:
    """(finding_id, actor): the timeline of the finding's principal, else the first that shares an address.

    findings: (finding_id, user_name, principal_id, ips).  First means seen first, then by name.  addresses: all values of actors, for those that have more addresses
    than their timeline lists.
    """
    keys = findings.select("finding_id", F.explode(F.array_distinct(F.array_compact(F.array(F.nullif("user_name", F.lit("")), F.nullif("principal_id", F.lit("")))))).alias("key"))
    named = lines.select("actor", "first_seen", F.col("actor").alias("key"))
    if by_short_name:
        named = named.union(lines.select("actor", "first_seen", F.element_at(F.split("actor", "/"), -1).alias("key"))).distinct()
    best = F.min(F.struct("first_seen", "actor"))["actor"]
    exact = keys.join(named, "key").groupBy("finding_id").agg(best.alias("actor"), F.lit("principal").alias("matched_by"))
    rest = findings.join(exact, "finding_id", "left_anti").select("finding_id", F.explode("ips").alias("ip")).distinct()
    # one actor for each address first, so that a shared address meets each finding once
    who = F.struct("first_seen", "actor").alias("who")
    if addresses is None:
        shown = lines.select(who, F.explode("source_ips").alias("ip"))
    else:
        shown = addresses.filter("dimension = 'source_ip'").select("actor", F.col("value").alias("ip")).join(lines.select("actor", "first_seen"), "actor").select(who, "ip")
    seen = shown.groupBy("ip").agg(F.min("who").alias("who"))
    by_ip = rest.join(seen, "ip").groupBy("finding_id").agg(F.min("who")["actor"].alias("actor"), F.lit("address").alias("matched_by"))
    return exact.union(by_ip)


def sequences(findings: DataFrame) -> DataFrame:
    """Attack sequences in short: (id, type, severity, title, description, account, region, signal_count, actors)."""
    return findings.select("id", "type", "severity", "title", truncated(F.col("description"), 400).alias("description"), "account", "region", F.coalesce(F.size("signals"), F.lit(0)).alias("signal_count"), F.transform("actors", lambda a: a["id"]).alias("actors"))


def is_sequence() -> Column:
    """Whether a finding is an attack sequence: by its type, or because it has signals."""
    return F.col("type").contains("AttackSequence") | (F.coalesce(F.size("signals"), F.lit(0)) > 0)


def split_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single findings, and attack sequences."""
    hit = F.coalesce(is_sequence(), F.lit(False))
    return findings.filter(~hit), findings.filter(hit)


def findings_summary(findings: DataFrame) -> DataFrame:
    """Single findings in short."""
    return split_findings(findings)[0].select("type", "severity", "title", "account", "region")


def by_count(lines: DataFrame) -> DataFrame:
    """Timelines, the busiest actors first; of equal ones those seen first."""
    return lines.orderBy(F.desc("event_count"), "first_seen", "actor")


def by_actions(sessions: DataFrame) -> DataFrame:
    """Sessions, those with the most actions first."""
    return sessions.orderBy(F.desc("action_count"), "key")


def compromised_principals(chains: DataFrame, sessions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct principals behind chains, sessions with notable actions, and severe patterns."""
    found = chains.select("actor").union(sessions.filter(F.size("notable") > 0).select("assumed_by")).union(patterns.filter(F.col("severity").isin("critical", "high")).select("actor"))
    return found.filter("actor <> ''").distinct()


def summary(**parts: DataFrame) -> DataFrame:
    """One row with the number of rows of each part."""
    rows = None
    for n, df in parts.items():
        one = df.select(F.lit(n).alias("part"))
        rows = one if rows is None else rows.union(one)
    return rows.agg(*[F.count_if(F.col("part") == n).alias(n) for n in parts])
