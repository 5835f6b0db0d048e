"""The catalogue of governance policies: one operator, many configurations.

A policy profiles observations by key, bands the profile and gates it; every
gate lists its failing reasons and opens only without any.  Observations carry
the columns that a policy's measures name; flags are booleans, null meaning no.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import profile_gate


def _rate(flag: str) -> str:
    return f"round(count(*) FILTER (WHERE {flag}) / count(*), 4)"


def _count(flag: str) -> str:
    return f"count(*) FILTER (WHERE {flag})"


@dataclass(frozen=True)
class Policy:
    """measures: name -> SQL aggregate; bands: (name, SQL condition), the first that holds; blocks: (SQL condition, reason)."""

    measures: Mapping[str, str]
    bands: Sequence[tuple[str, str]]
    otherwise: str
    blocks: Sequence[tuple[str, str]] = field(default=())


# Thresholds of the policies.
POLICIES = {
    "shadow_safety": Policy({"n": "count(*)", "unsafe": _count("unsafe"), "agreement": _rate("agree")}, [("BLOCKED", "unsafe > 0"), ("OBSERVING", "n < 20 OR agreement < 0.9")], "ELIGIBLE", [("unsafe > 0", "UNSAFE"), ("n < 20", "FEW_SAMPLES"), ("agreement < 0.9", "LOW_AGREEMENT")]),
    "canary_outcome": Policy({"completed": "count(*)", "divergence": _rate("NOT agree"), "false_optimism": _count("unsafe")}, [("BLOCKED", "false_optimism > 0"), ("READY", "completed >= 3 AND divergence <= 0.4")], "OBSERVING", [("false_optimism > 0", "FALSE_OPTIMISM"), ("completed < 3", "FEW"), ("divergence > 0.4", "DIVERGENT")]),
    "preventive_canary": Policy({"outcomes": "count(*)", "false_hold": _rate("harmful")}, [("OBSERVING", "outcomes < 3"), ("BLOCKED", "false_hold > 0.25")], "READY", [("outcomes < 3", "FEW"), ("false_hold > 0.25", "FALSE_HOLDS")]),
    "quarantine_reintegration": Policy({"hours": "max(hours)", "shadow": "count(*)", "missed": _count("unsafe"), "false_hold": _rate("harmful")}, [("READY", "hours >= 24 AND shadow >= 7 AND missed = 0 AND false_hold <= 0.1")], "HELD", [("hours < 24", "TOO_SOON"), ("shadow < 7", "FEW"), ("missed > 0", "MISSED"), ("false_hold > 0.1", "FALSE_HOLDS")]),
    "remediation_effectiveness": Policy({"attempts": "count(*)", "sustained": _rate("helpful")}, [("LOW_DATA", "attempts < 3"), ("ESTABLISHED", "sustained >= 0.6")], "EMERGING", [("attempts < 3", "FEW")]),
    "recommendation_challenge": Policy({"decisive": _count("helpful OR harmful"), "distinct_events": "count(DISTINCT day)"}, [("READY", "decisive >= 8 AND distinct_events >= 8")], "WARMING", [("decisive < 8", "FEW_DECISIVE"), ("distinct_events < 8", "FEW_EVENTS")]),
    "recommendation_policy": Policy({"decisive": _count("helpful OR harmful"), "helpful_rate": _rate("helpful"), "harmful_rate": _rate("harmful")}, [("READY", "decisive >= 5 AND helpful_rate >= 0.6 AND harmful_rate <= 0.1")], "WARMING", [("decisive < 5", "FEW"), ("helpful_rate < 0.6", "UNHELPFUL"), ("harmful_rate > 0.1", "HARMFUL")]),
    "version_cohort": Policy({"decisive": _count("helpful OR harmful"), "harmful": _count("harmful"), "median_hours": "median(hours)"}, [("UNSAFE", "harmful * 4 > decisive"), ("WATCH", "harmful > 0")], "SAFE", [("harmful * 4 > decisive", "HARMFUL")]),
    "fallback_verification": Policy({"seen": "count(*)", "helpful": _count("helpful"), "harmful": _count("harmful")}, [("FAILED", "harmful > 0"), ("STABLE", "helpful >= 4"), ("WATCH", "seen >= 5")], "ACTIVE", [("harmful > 0", "HARMFUL"), ("helpful < 4", "FEW_HELPFUL")]),
    "threshold_calibration": Policy({"reviews": "count(*)", "precision": _rate("agree"), "false_positive": _rate("NOT agree")}, [("KEEP", "reviews < 5"), ("TIGHTEN", "false_positive >= 0.25"), ("RELAX", "false_positive <= 0.1 AND precision >= 0.9")], "KEEP", [("reviews < 5", "FEW")]),
    "recurrence_band": Policy({"cases": "count(*)", "harmful_rate": _rate("harmful")}, [("BASELINE", "cases <= 1"), ("ELEVATED", "cases = 2")], "RESTRICTED", [("harmful_rate > 0.25", "HARMFUL")]),
    "source_reliability": Policy({"score": f"round(greatest(0.2, least(1.0, 1.0 - 0.2 * {_count('harmful')} + 0.025 * {_count('NOT harmful')})), 4)"}, [("TRUSTED", "score >= 0.9"), ("WATCH", "score >= 0.7")], "CRITICAL", [("score < 0.7", "UNRELIABLE")]),
}


def judged(observations: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The profile, band, reasons and readiness of each key under the named policy."""
    p = POLICIES[name]
    return profile_gate(observations, keys, {k: F.expr(v) for k, v in p.measures.items()}, [(b, F.expr(c)) for b, c in p.bands], p.otherwise, [(F.expr(c), r) for c, r in p.blocks])


def catalogue(observations: DataFrame, key: str) -> DataFrame:
    """policy, key, band, reasons, ready for every policy."""
    found = None
    for name in POLICIES:
        part = judged(observations, [key], name).select(F.lit(name).alias("policy"), key, "band", "reasons", "ready")
        found = part if found is None else found.unionAll(part)
    return found


def contextual_ranking(plans: DataFrame, group: str) -> DataFrame:
    """Remediation plans by a weighted score; PREFERRED if decisive, good enough and ahead of the next by a margin.

    ``plans`` has group, plan, decisive, wilson, bayes, survival_days, context, evidence, severity, steps.
    """
    from pyspark.sql import Window

    score = F.round(0.35 * F.col("wilson") + 0.15 * F.col("bayes") + 0.15 * F.least(F.col("survival_days") / 90.0, F.lit(1.0)) + 0.20 * F.col("context") + 0.15 * F.col("evidence") - 0.15 * F.col("severity") - 0.05 * F.col("steps"), 6)
    order = Window.partitionBy(group).orderBy(F.desc("score"), "plan")
    ranked = plans.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long")).withColumn("margin", F.round(F.col("score") - F.lead("score").over(order), 6))
    ahead = (F.col("rank") == 1) & (F.col("decisive") >= 3) & (F.col("score") >= 0.45) & F.coalesce(F.col("margin") >= 0.08, F.lit(True))
    return ranked.select(group, "plan", "score", "rank", F.when(ahead, "PREFERRED").when(F.col("decisive") < 3, "LOW_DATA").otherwise("LEARNING").alias("status"))


def regret(choices: DataFrame) -> DataFrame:
    """key, regret, class of choices (key, recommended, selected): how much better the recommended one did."""
    lost = F.greatest(F.lit(0.0), F.col("recommended") - F.col("selected"))
    return choices.select("key", F.round(lost, 6).alias("regret"), F.when(lost > 0, "OVERRIDE_WORSE").when(F.col("selected") > F.col("recommended"), "OVERRIDE_BETTER").otherwise("EVEN").alias("outcome"))
