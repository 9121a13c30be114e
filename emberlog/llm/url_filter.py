"""URL filtering by rules, and by trust and distrust that spread over the link graph.

A rule (host, path) fits its host and all subdomains where the path of the URL starts with the
rule's; the longest host wins, then the longest path.  Pages that no rule fits get the verdict of
their host.  A host is a trusted seed by the share of its pages that a rule allows, and a
blocked seed by the share that a rule blocks.  Trust follows the links between hosts
(personalised PageRank); distrust runs from blocked hosts back to those that link to them
(the same on the reversed links).  Both are scaled so that a seed without links keeps its share.
A host is blocked when its distrust exceeds its trust by more than the threshold.

Links come from absolute addresses in href attributes of the HTML, with or without http: or https:; they are counted by host pair
before anything else, so a host with very many pages is one row of the graph.  Spark SQL
throughout; each step is checkpointed and the steps end when no value moves any more.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; hosts without links or seeds are allowed; repeated rows are judged each on its own;
columns other than id, URL and HTML are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  #: allow or block
    text: str  #: host and path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class Settings:
    damping: float = 0.85
    threshold: float = 0.5
    tolerance: float = 1e-4
    steps_at_once: int = 4
    broadcast_hosts: int = 500_000  #: hosts up to this number are broadcast, more are joined by a shuffle


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(text, verdict) of the winning rule, or null."""
    order = sorted(rules, key=lambda r: (-len(r.host), -len(r.path), r.text))
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<text string, verdict string>")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many pages of a host link to another host."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?(//[^"'\s<>]+)"""), F.lit(1))
    targets = F.array_distinct(F.transform(hrefs, lambda h: host_of(F.concat(F.lit(":"), h))))
    some = pages.filter(F.col("html").contains("//"))
    pairs = some.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return pairs.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(kind, host, value): value = seed + damping * (shares of the values of those that point to it), for each kind on its own.

    seeds: (kind, host, seed) of every host; edges: (kind, src, dst, share), the shares of a src sum to 1.  The sum of
    all moves falls by the damping in each step, so the steps end.  A few steps are planned at once, then checkpointed.
    """
    if not 0 <= settings.damping < 1 or settings.tolerance <= 0:
        raise ValueError("damping must be at least 0 and less than 1, and tolerance positive")
    values = checkpointed(seeds.withColumn("value", F.col("seed")))
    moving = not edges.isEmpty()
    while moving:
        moved = values.withColumn("old", F.col("value"))
        for _ in range(settings.steps_at_once):
            flow = edges.join(moved.select("kind", F.col("host").alias("src"), "value"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("value") * F.col("share")).alias("flow"))
            moved = moved.join(flow, ["kind", "host"], "left").select("kind", "host", "seed", F.col("value").alias("old"), (F.col("seed") + settings.damping * F.coalesce("flow", F.lit(0.0))).alias("value"))
        moved = checkpointed(moved)
        values = moved.select("kind", "host", "seed", "value")
        moving = not moved.filter(F.abs(F.col("value") - F.col("old")) > settings.tolerance).isEmpty()
    return values.select("kind", "host", "value")


def _shares(edges: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    total = edges.groupBy(F.col(src).alias("from")).agg(F.sum("n").alias("total"))
    return edges.join(total, edges[src] == total["from"]).select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("total")).alias("share"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.count_if(F.col("__rule.verdict") == v) / F.count("*")
    edges = checkpointed(links(pages))
    seeds = parsed.filter("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    seeds = checkpointed(seeds.join(edges.select(F.col("dst").alias("host")).distinct(), "host", "full_outer").na.fill(0.0))
    shares = checkpointed(_shares(edges, "trust", "src", "dst").union(_shares(edges, "distrust", "dst", "src")))
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed")))
    values = spread(seeds.select("host", F.explode(kinds).alias("k")).select("k.kind", "host", "k.seed"), shares, settings)
    value = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
    scores = checkpointed(values.groupBy("host").agg(value("trust"), value("distrust")))
    few = scores.count() <= settings.broadcast_hosts
    out = parsed.join(F.broadcast(scores) if few else scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") - F.col("trust") > settings.threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__rule.text").alias("rule"), F.coalesce("__rule.verdict", by_host).alias("verdict"), "trust", "distrust")
