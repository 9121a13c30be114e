"""Priority scores of plan steps as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import rules


def clamp(v: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def _two(v: Column) -> Column:
    """To two places; the first rounding takes away what binary fractions add."""
    return F.round(F.round(v, 8), 2)


def _pick(c: Column, values: dict, default: float) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(float(v))) for k, v in values.items()], F.lit(float(default)))


def business_impact(tier: Column, impact: Column, sensitivity: Column, sla: Column) -> Column:
    t = _pick(tier, {1: 10, 2: 8, 3: 5, 4: 2}, 5)
    i = _pick(impact, {"severe": 10, "high": 8, "moderate": 5, "low": 2}, 5)
    s = _pick(F.lower(sensitivity), {"pci": 10, "phi": 10, "phii": 10, "customer": 7.5, "internal": 5, "public": 1}, 5)
    return _two(clamp(t * 0.40 + i * 0.35 + s * 0.15 + F.when(sla, 10.0).otherwise(0.0) * 0.10))


def group_id(name: Column) -> Column:
    """The id of a threat group by id or alias, without case; else null."""
    ids = [F.when(F.upper(name) == g, g) for g, *_ in rules.THREAT_GROUPS]
    aliases = [F.when(F.lower(name) == a.lower(), g) for g, _, _, names in rules.THREAT_GROUPS for a in names]
    return F.coalesce(*ids, *aliases)


def threat_confidence(confidence: Column, groups: Column, n_iocs: Column, n_sources: Column) -> Column:
    tier = {g: 2.0 if t == "state" else 1.5 for g, _, t, _ in rules.THREAT_GROUPS}
    # by name in lower case; ids come first, then the first group of an alias
    named = [(g, g) for g, *_ in rules.THREAT_GROUPS] + [(a, g) for g, _, _, names in rules.THREAT_GROUPS for a in names]
    known = F.create_map(*[F.lit(x) for n, g in reversed({n.lower(): (n, g) for n, g in reversed(named)}.values()) for x in (n.lower(), tier[g])])
    bonus = F.coalesce(F.array_max(F.transform(groups, lambda g: F.coalesce(F.try_element_at(known, F.lower(g)), F.lit(0.0)))), F.lit(0.0))
    more = lambda n, most: F.least(F.lit(most), F.greatest(F.lit(0), F.coalesce(n, F.lit(0)) - 1) * 0.5)
    return _two(clamp(F.coalesce(confidence.cast("double") / 10, F.lit(5.0)) + bonus + more(n_iocs, 2.0) + more(n_sources, 1.0)))


def evidence_quality(completeness: Column, reliability: Column, confidence: Column, blind_spots: Column, gaps: Column) -> Column:
    mean = sum((F.coalesce(c, F.lit(50)) / 10 for c in (completeness, reliability, confidence)), F.lit(0.0)) / 3
    return _two(clamp(mean - F.coalesce(blind_spots, F.lit(0)) * 1.0 - F.coalesce(gaps, F.lit(0)) * 0.5))


def response_effort(level: Column, analysts: Column) -> Column:
    base = _pick(F.when(F.coalesce(level, F.lit(0)) == 0, 3).otherwise(level), {1: 1, 2: 3, 3: 5, 4: 7.5, 5: 10}, 5)
    return _two(clamp(F.when(analysts > 1, base / (1 + (analysts - 1) * 0.35)).otherwise(base), low=1.0))


def effort_level(action: Column, phrases: Sequence[tuple[str, int]], multiplier: float = 1.0) -> Column:
    """The level of the first phrase that the action contains (3 for none), times the provider's multiplier."""
    level = F.coalesce(*[F.when(F.lower(action).contains(p.lower()), n) for p, n in phrases], F.lit(3))
    return clamp(F.round(level * multiplier), 1, 5).cast("int")


def composite(impact: Column, confidence: Column, effort: Column, quality: Column, weights: dict[str, float] = rules.WEIGHTS) -> Column:
    return _two(impact * weights["business_impact"] + confidence * weights["threat_confidence"] + (10 - effort) * weights["response_effort"] + quality * weights["evidence_quality"])


def priority(score: Column, thresholds: dict[str, float] = rules.THRESHOLDS) -> Column:
    return F.coalesce(*[F.when(score >= thresholds[p], p) for p in ("critical", "high", "medium")], F.lit("low"))


def overdue(flag: Column, age: Column, window: Column) -> Column:
    """The flag where there is one, else whether the age exceeds the window."""
    return F.coalesce(flag, age > window, F.lit(False))


def score_steps(steps: DataFrame, weights: dict[str, float] = rules.WEIGHTS, thresholds: dict[str, float] = rules.THRESHOLDS) -> DataFrame:
    """Adds the four dimensions, the composite score, the priority and whether a step is overdue."""
    c = F.col
    crit, intel, ev, t = "business_criticality", "threat_intel_enrichment", "evidence_quality", "time_sensitivity"
    return (
        steps.withColumn("business_impact", business_impact(c(f"{crit}.criticality_tier"), c(f"{crit}.impact_if_compromised"), c(f"{crit}.data_sensitivity"), c(f"{crit}.sla_breach_risk")))
        .withColumn("threat_confidence", threat_confidence(c(f"{intel}.confidence"), c(f"{intel}.associated_threat_groups"), F.greatest(F.size(f"{intel}.linked_iocs"), F.lit(0)), F.greatest(F.size(f"{intel}.data_sources"), F.lit(0))))
        .withColumn("quality", evidence_quality(c(f"{ev}.completeness"), c(f"{ev}.reliability"), c(f"{ev}.confidence"), F.greatest(F.size(f"{ev}.blind_spots"), F.lit(0)), F.greatest(F.size(f"{ev}.evidence_gaps"), F.lit(0))))
        .withColumn("effort", response_effort(c("response_effort"), F.coalesce("assigned_analysts", F.lit(1))))
        .withColumn("score", composite(c("business_impact"), c("threat_confidence"), c("effort"), c("quality"), weights))
        .withColumn("priority", priority(c("score"), thresholds))
        .withColumn("is_overdue", overdue(c(f"{t}.overdue"), c(f"{t}.incident_age_hours"), c(f"{t}.optimal_response_window_hours")))
    )


def by_priority(scored: DataFrame) -> DataFrame:
    tier = F.coalesce("business_criticality.criticality_tier", F.lit(3))
    return scored.orderBy(F.desc("score"), F.desc("is_overdue"), tier, "step")


def critical_path(scored: DataFrame) -> DataFrame:
    """Urgent steps (critical, or high and overdue; overdue first, then by score), then the other high ones."""
    urgent = (F.col("priority") == "critical") | ((F.col("priority") == "high") & F.col("is_overdue"))
    kept = scored.filter(urgent | (F.col("priority") == "high")).withColumn("path_bucket", F.when(urgent, 0).otherwise(1))
    return kept.orderBy("path_bucket", F.when(urgent & ~F.col("is_overdue"), 1).otherwise(0), F.desc("score"), "step")


def resolve(steps: DataFrame, found: Sequence[str]) -> DataFrame:
    """Drops blind spots and gaps that contain any of the texts, without case; score the result anew."""
    hit = lambda s: F.exists(F.array(*[F.lit(x.lower()) for x in found]), lambda x: F.lower(s).contains(x)) if found else F.lit(False)
    ev = F.col("evidence_quality")
    return steps.withColumn("evidence_quality", ev.withField("blind_spots", F.filter(ev["blind_spots"], lambda s: ~hit(s))).withField("evidence_gaps", F.map_filter(ev["evidence_gaps"], lambda k, _: ~hit(k))))
