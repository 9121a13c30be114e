"""Indicators: extraction from events and findings, and enrichment from feeds."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from emberlog import rules


def _number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    value = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    plain = F.forall(p, lambda x: (x.try_cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
    return F.when((F.size(p) == 4) & plain, value)


def is_ipv4(ip: Column) -> Column:
    """Whether a dotted text is an IPv4 address; null counts as no."""
    return _number(ip).isNotNull()


def routable_ipv4(ip: Column) -> Column:
    """Whether a dotted IPv4 address is valid and publicly routable; null counts as no."""
    n, inside = _number(ip), F.lit(False)
    for first, bits in rules.UNROUTABLE:
        low = int(ipaddress.IPv4Address(first))
        inside = inside | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(~inside, F.lit(False))


@F.pandas_udf(BooleanType())
def routable(values: pd.Series) -> pd.Series:
    """The same for addresses of both versions."""

    def one(v: str | None) -> bool:
        try:
            a = ipaddress.ip_address(v or "")
        except ValueError:
            return False
        return not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved)

    return values.map(one)


def denied_domain(domain: Column) -> Column:
    low, hit = F.lower(domain), F.lit(False)
    for d in rules.DOMAIN_DENYLIST:
        hit = hit | (low == d) | low.endswith("." + d)
    return hit


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def indicators_in(text: Column, hashes: bool = True) -> Column:
    """Array of (kind, value): routable IPv4 addresses, domains not on the denylist, and hashes."""
    pair = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value"))
    found = [
        F.transform(F.filter(_all(text, rules.IPV4), routable_ipv4), pair("ip")),
        F.transform(F.filter(_all(text, rules.DOMAIN), lambda d: ~denied_domain(d)), pair("domain")),
    ]
    if hashes:
        found += [F.transform(_all(text, rules.SHA256), pair("sha256")), F.transform(_all(text, rules.MD5), pair("md5"))]
    return F.array_distinct(F.flatten(F.array(*found)))


def event_indicators(events: DataFrame) -> DataFrame:
    """(kind, value, context): of source addresses; one that isn't an address may hold domains. The first event wins."""
    dotted = F.col("source_ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    ip = F.col("source_ip")
    # only addresses with colons reach Python
    public = F.when(ip.contains(":"), routable(F.when(ip.contains(":"), ip))).otherwise(routable_ipv4(ip))
    address = F.when(public, F.array(F.struct(F.lit("ip").alias("kind"), F.lower("source_ip").alias("value"))))
    domains = F.when(~dotted, F.filter(indicators_in(F.col("source_ip"), hashes=False), lambda i: i["kind"] == "domain"))
    found = events.filter("source_ip <> ''").select("event_time", "row_id", F.concat(F.col("event_name"), F.lit(" by "), F.coalesce(F.nullif("actor.arn", F.lit("")), F.nullif("actor.user_name", F.lit("")), F.lit("unknown"))).alias("context"), F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(address, domains))))).alias("i"))
    return found.groupBy("i.kind", "i.value").agg(F.min_by("context", F.struct("event_time", "row_id")).alias("context"))


def finding_indicators(findings: DataFrame) -> DataFrame:
    """(kind, value, context) of title, description, type and action of findings."""
    text = F.concat_ws(" ", "title", "description", "type", "action")
    found = findings.select("finding_id", F.col("title").alias("context"), F.explode(indicators_in(text)).alias("i"))
    return found.groupBy("i.kind", "i.value").agg(F.min_by("context", "finding_id").alias("context"))


def all_indicators(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Both; where both have one, the finding's context stands."""
    both = event_indicators(events).withColumn("source", F.lit("event")).unionByName(finding_indicators(findings).withColumn("source", F.lit("finding")))
    return both.groupBy("kind", "value").agg(F.max_by(F.struct("context", "source"), "source").alias("x")).select("kind", "value", "x.*")


def group_of(text: Column) -> Column:
    """The id of the first threat group, in order of the aliases, that the text names."""
    low = F.lower(text)
    hits = [F.when(low.contains(alias.lower()), gid) for gid, _, _, aliases in rules.THREAT_GROUPS for alias in aliases]
    return F.coalesce(*hits)


def group_name(gid: Column) -> Column:
    return F.coalesce(*[F.when(gid == g, name) for g, name, _, _ in rules.THREAT_GROUPS])


def enrich(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Indicators with what the feeds say: highest confidence, all groups, categories and feeds.

    feed: (feed, kind, indicator, confidence, category, description, group_id); Spark broadcasts it if its size is below the threshold.
    """
    f = feed.select(F.col("kind"), F.col("indicator").alias("value"), "feed", "confidence", "category", "group_id")
    hits = indicators.join(f, ["kind", "value"], "left")
    sets = lambda c: F.array_sort(F.collect_set(c))
    return hits.groupBy("kind", "value").agg(
        F.first("context").alias("context"),
        (F.count("feed") > 0).alias("malicious"),
        F.max("confidence").alias("confidence"),
        sets("group_id").alias("groups"),
        sets(group_name(F.col("group_id"))).alias("group_names"),
        sets("category").alias("categories"),
        sets("feed").alias("feeds"),
    )


def attributed_groups(enriched: DataFrame) -> DataFrame:
    """The distinct names of the groups behind the indicators."""
    return enriched.select(F.explode("group_names").alias("group_name")).distinct()


def lookup(feed: DataFrame, value: str) -> DataFrame:
    """What the feeds say about one value: an address, a SHA-256 hash, or else a domain."""
    kind = "ip" if value.replace(".", "").isdigit() and value.count(".") == 3 or ":" in value else "sha256" if len(value) == 64 else "domain"
    return feed.filter((F.col("kind") == kind) & (F.col("indicator") == value.lower()))
