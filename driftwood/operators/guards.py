"""Guards that watch the last outcomes of a key, and the scores that rank what to do next.

A guard reads the last few rows of each key, however long its history is: one
rank over the key's order gives every window, and one aggregate all of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import wilson_low

# Sizes of the windows, and the limits at which one rolls back: (regressions, miss rate, false positive rate).
WINDOWS = (5, 10, 20)
ROLLBACK = {5: (2, 0.20, 0.40), 10: (2, 0.10, 0.25), 20: (3, 0.10, 0.20)}
#: Regressions, or losses of coverage, that isolate a scope again.
REISOLATE = {5: 2, 10: 2, 20: 3}
#: A drop of coverage beyond this is a loss.
COVERAGE_DROP = 0.10
# Weights of a context's features, and the score that a matching root cause starts from.
CONTEXT_BASE = 0.15
CONTEXT_WEIGHTS = {"scope_type": 0.20, "source_id": 0.20, "platform": 0.15, "rule_key": 0.10, "secondary_cause": 0.10, "alternative_route": 0.10}


def last_windows(log: DataFrame, key: str, order: Sequence[Column], measures: Mapping[str, Column], sizes: Sequence[int] = WINDOWS) -> DataFrame:
    """key, size, observed and each measure (an aggregate) over the key's last ``size`` rows, for every size.

    Only the last rows of a key are kept before the windows are dealt, so a
    key's history costs one bounded sort.
    """
    newest = Window.partitionBy(key).orderBy(*order)
    last = log.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= max(sizes))
    dealt = last.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter(F.col("_nth") <= F.col("size"))
    return dealt.groupBy(key, "size").agg(F.count("*").alias("observed"), *[m.alias(n) for n, m in measures.items()])


def _rate(part: Column, whole: Column) -> Column:
    """0 where nothing could have gone wrong."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def runtime_guard(outcomes: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """key, size, observed, miss_rate, false_positive_rate, regressions, status of ``outcomes`` (key, predicted, actual, regression, critical).

    A critical regression rolls back at once; a full window rolls back at its
    limits; the smallest also asks for a closer look before that.
    """
    hit = lambda p, a: F.count_if((F.col("predicted") == p) & (F.col("actual") == a))
    found = last_windows(outcomes, key, order, {"tp": hit(True, True), "fp": hit(True, False), "fn": hit(False, True), "tn": hit(False, False), "regressions": F.count_if("regression"), "critical": F.count_if(F.col("regression") & F.col("critical"))})
    found = found.withColumn("miss_rate", F.round(_rate(F.col("fn"), F.col("tp") + F.col("fn")), 4)).withColumn("false_positive_rate", F.round(_rate(F.col("fp"), F.col("fp") + F.col("tn")), 4))
    full, over, watch = F.col("observed") >= F.col("size"), F.lit(False), F.lit(False)
    for size, (regressions, miss, wrong) in ROLLBACK.items():
        here = full & (F.col("size") == size)
        over = over | (here & ((F.col("regressions") >= regressions) | (F.col("miss_rate") >= miss) | (F.col("false_positive_rate") >= wrong)))
        if size == min(ROLLBACK):
            watch = here & ((F.col("regressions") == 1) | (F.col("false_positive_rate") >= wrong / 2))
    status = F.when((F.col("critical") > 0) | over, "ROLLBACK").when(watch, "WATCH").when(~full, "WARMING").otherwise("HEALTHY")
    return found.select(key, "size", "observed", "miss_rate", "false_positive_rate", "regressions", status.alias("status"))


def reintegration_guard(outcomes: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """key, size, observed, status of ``outcomes`` (key, regression, critical, false_corroboration, missed, coverage_change) after a scope came back.

    Any critical regression, false corroboration or missed item isolates it
    again; so do enough regressions or losses of coverage.
    """
    measures = {"regressions": F.count_if("regression"), "worst": F.count_if((F.col("regression") & F.col("critical")) | F.col("false_corroboration") | F.col("missed")), "lost": F.count_if(F.col("coverage_change") < -COVERAGE_DROP)}
    found = last_windows(outcomes, key, order, measures)
    most = F.lit(None).cast("int")
    for size, n in REISOLATE.items():
        most = F.when(F.col("size") == size, n).otherwise(most)
    full, any_ = F.col("observed") >= F.col("size"), (F.col("regressions") > 0) | (F.col("lost") > 0)
    status = F.when((F.col("worst") > 0) | (F.col("regressions") >= most) | (F.col("lost") >= most), "REISOLATE").when(full & any_, "WATCH").when(~full, "WARMING").otherwise("HEALTHY")
    return found.select(key, "size", "observed", status.alias("status"))


def rolling_stability(log: DataFrame, key: str, order: Sequence[Column], previous: DataFrame | None = None, least: int = 20, agreement: float = 0.9, sizes: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """key, samples, cumulative, status, downgraded of shadow comparisons (key, agree, unsafe).

    Unsafe rows anywhere, or in the last 7 or 14, block; the whole and the
    first two windows must be stable, and the third once there are so many.
    ``previous`` (key, status) tells a fall from ELIGIBLE to BLOCKED.
    """
    measures = {"agreed": F.count_if("agree"), "unsafe": F.count_if("unsafe")}
    windows = last_windows(log, key, order, measures, sizes)
    state = F.when(F.col("unsafe") > 0, "BLOCKED").when((F.col("observed") >= F.col("size")) & (F.col("agreed") / F.col("observed") >= agreement), "STABLE").otherwise("OBSERVING")
    wide = windows.groupBy(key).agg(*[F.max(F.when(F.col("size") == s, state)).alias(f"w{s}") for s in sizes])
    whole = log.groupBy(key).agg(F.count("*").alias("samples"), *[m.alias(n) for n, m in measures.items()])
    cumulative = F.when(F.col("unsafe") > 0, "BLOCKED").when((F.col("samples") < least) | (F.col("agreed") / F.col("samples") < agreement), "OBSERVING").otherwise("ELIGIBLE")
    a, b, c = (F.col(f"w{s}") for s in sizes)
    status = (
        F.when((F.col("cumulative") == "BLOCKED") | (a == "BLOCKED") | (b == "BLOCKED"), "BLOCKED")
        .when((F.col("cumulative") != "ELIGIBLE") | (a != "STABLE") | (b != "STABLE"), "OBSERVING")
        .when((F.col("samples") >= max(sizes)) & (c != "STABLE"), "OBSERVING")
        .otherwise("ELIGIBLE")
    )
    out = whole.withColumn("cumulative", cumulative).join(wide, key).withColumn("status", status)
    before = F.lit(None).cast("string")
    if previous is not None:
        out, before = out.join(previous.select(key, F.col("status").alias("_before")), key, "left"), F.col("_before")
    return out.select(key, "samples", "cumulative", "status", F.coalesce((before == "ELIGIBLE") & (F.col("status") == "BLOCKED"), F.lit(False)).alias("downgraded"))


def context_similarity(candidate: Column, target: Column, weights: Mapping[str, float] = CONTEXT_WEIGHTS) -> Column:
    """How alike two contexts (structs) are: the weights of equal features; a feature the target does not know counts half."""
    score = F.lit(CONTEXT_BASE)
    for name, w in weights.items():
        wanted, has = target.getField(name), candidate.getField(name)
        score = score + F.when(wanted.isNull(), w * 0.5).when(wanted.eqNullSafe(has), w).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def family_ranking(profiles: DataFrame, case: Column) -> DataFrame:
    """family, remedy, score, state of remediation profiles (family, remedy, attempts, sustained, failed, survival_days, band) for a case's family.

    A lower bound of the success rate, survival, evidence and context speak
    for a remedy; every recurrence against it, up to three.
    """
    decisive = F.col("sustained") + F.col("failed")
    same = F.col("family") == case
    score = F.coalesce(wilson_low(F.col("sustained"), decisive), F.lit(0.0)) * 0.40 + F.least(F.col("survival_days") / 90.0, F.lit(1.0)) * 0.20 + F.least(F.col("attempts") / 5.0, F.lit(1.0)) * 0.20 + F.when(same, 1.0).otherwise(0.65) * 0.20 - F.least(F.col("failed") * 0.20, F.lit(0.60))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    state = (
        F.when((F.col("band") == "AVOID") | (F.col("failed") >= 2), "AVOID")
        .when((decisive < 1) | (F.col("attempts") < 2), "LOW_DATA")
        .when(same & (F.col("sustained") >= 2) & (F.col("failed") == 0) & (F.col("attempts") >= 2) & (F.col("score") >= 0.45), "PREFERRED")
        .when(F.col("failed") > 0, "WATCH")
        .otherwise("LEARNING")
    )
    return profiles.withColumn("score", score).select("family", "remedy", "score", state.alias("state"))


def canary_assignments(events: DataFrame, key: str, order: Sequence[Column], assigned: DataFrame, room: int) -> DataFrame:
    """key, mode: CANARY for keys already ``assigned`` and for the first others while there is room for ``room`` in all; else BASE_OR_FULL.

    Only as many new keys as there is room for are ranked.
    """
    old = assigned.select(key, F.lit(True).alias("_old"))
    seen = events.join(old, key, "left")
    free = F.greatest(F.lit(0), F.lit(room) - assigned.count())
    new = seen.filter("_old is null").groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first", key).limit(room)
    nth = F.row_number().over(Window.orderBy("_first", key))
    new = new.select(key, (nth <= free).alias("_new"))
    mode = F.when(F.col("_old") | F.coalesce("_new", F.lit(False)), "CANARY").otherwise("BASE_OR_FULL")
    return seen.select(key, "_old").distinct().join(new, key, "left").select(key, mode.alias("mode"))


def closure(clusters: DataFrame, evidence: DataFrame, attributions: DataFrame) -> DataFrame:
    """cluster_id, unresolved, open, ready of clusters (cluster_id, status, severity): whether one may be closed.

    ``evidence`` has cluster_id, active, critical; ``attributions`` cluster_id
    and the state of the linked work (null without any).  A confirmed case
    needs an attribution, a critical one work that is all verified.
    """
    left = evidence.groupBy("cluster_id").agg(F.count_if(F.col("active") & F.col("critical")).alias("unresolved"))
    work = attributions.groupBy("cluster_id").agg(F.count("*").alias("causes"), F.count("state").alias("linked"), F.count_if(F.col("state").isin("OPEN", "IN_PROGRESS")).alias("open"), F.count_if(F.col("state") == "VERIFIED").alias("verified"))
    joined = clusters.join(left, "cluster_id", "left").join(work, "cluster_id", "left").fillna(0, ["unresolved", "causes", "linked", "open", "verified"])
    ready = F.col("status").isin("CONFIRMED_CASE", "DISMISSED") & (F.col("unresolved") == 0) & ((F.col("status") != "CONFIRMED_CASE") | (F.col("causes") > 0)) & ((F.col("severity") != "CRITICAL") | ((F.col("linked") > 0) & (F.col("verified") == F.col("linked"))))
    return joined.select("cluster_id", "unresolved", "open", ready.alias("ready"))


def calibration(reviews: DataFrame, cluster: str, order: Sequence[str]) -> DataFrame:
    """One row: reviewed, decisive, precision, false_positive over the latest review of each cluster (decision)."""
    latest = reviews.groupBy(cluster).agg(F.max_by("decision", F.struct(*order)).alias("decision"))
    counted = latest.agg(F.count("*").alias("reviewed"), F.count_if(F.col("decision") == "SYNDICATED").alias("s"), F.count_if(F.col("decision") == "INDEPENDENT").alias("i"))
    decisive = F.col("s") + F.col("i")
    share = lambda c: F.when(decisive > 0, F.round(F.col(c) / decisive, 4))
    return counted.select("reviewed", decisive.alias("decisive"), share("s").alias("precision"), share("i").alias("false_positive"))
