"""Counts, grids, funnels and gates over operational tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import failing, ratio


def completeness(rows: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """One row: total, and for every field how many have it and how many lack it."""
    have = [F.count_if(c).alias(f"with_{name}") for name, c in fields.items()]
    counted = rows.agg(F.count("*").alias("total"), *have)
    return counted.select("*", *[(F.col("total") - F.col(f"with_{name}")).alias(f"missing_{name}") for name in fields])


def filter_counts(rows: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """filter, n for each named filter, in one pass."""
    counted = rows.agg(*[F.count_if(c).alias(name) for name, c in filters.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(name).alias("n")) for name in filters])
    return counted.select(F.explode(pairs).alias("p")).select("p.filter", "p.n")


def dense_grid(rows: DataFrame, by: tuple[str, str], axes: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Counts by two keys with a zero for every pair of the axes; the axes are small dimensions."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    grid = axes[0].select(by[0]).distinct().crossJoin(axes[1].select(by[1]).distinct())
    return grid.join(counts, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def overall_and_by(rows: DataFrame, key: str, aggs: Sequence[Column], everything: str = "ALL") -> DataFrame:
    """The aggregates of each key and, under ``everything``, of all rows: grouping sets ((), (key))."""
    rolled = rows.rollup(key).agg(F.grouping(key).alias("_all"), *aggs)
    return rolled.withColumn(key, F.when(F.col("_all") == 1, everything).otherwise(F.coalesce(F.col(key).cast("string"), F.lit("UNKNOWN")))).drop("_all")


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision (null without positives), recall, fpr and miss (0 on nothing)."""
    counted = rows.agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "fpr": F.coalesce(ratio(fp, fp + tn), F.lit(0.0)),
            "miss": F.coalesce(ratio(fn, tp + fn), F.lit(0.0)),
        }
    )


def threshold_sweep(rows: DataFrame, score: str, actual: Column, thresholds: Sequence[float]) -> DataFrame:
    """precision and recall at each threshold, in one pass over the rows."""
    aggs = []
    for k, t in enumerate(thresholds):
        over = F.col(score) >= t
        aggs += [F.count_if(over & actual).alias(f"tp{k}"), F.count_if(over & ~actual).alias(f"fp{k}"), F.count_if(~over & actual).alias(f"fn{k}")]
    counted = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn")) for k, t in enumerate(thresholds)])
    flat = counted.select(F.explode(each).alias("r")).select("r.*")
    return flat.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def profile_gate(observations: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], bands: Sequence[tuple[str, Column]], otherwise: str, blocks: Sequence[tuple[Column, str]]) -> DataFrame:
    """Observations to counts and rates by key, then a band (first that holds) and a gate.

    The gate lists every failing reason as one string and is ready only if
    there is none; a measure that is null fails its condition.  All policies of
    the form "append observations, profile, band, gate" are calls of this.
    """
    profile = observations.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])
    band = None
    for name, condition in bands:
        condition = F.coalesce(condition, F.lit(False))
        band = F.when(condition, name) if band is None else band.when(condition, name)
    reasons = failing(*blocks)
    return profile.withColumn("band", band.otherwise(otherwise)).withColumn("reasons", F.array_join(reasons, ",")).withColumn("ready", F.size(reasons) == 0)


def hotspots(rows: DataFrame, first: str, second: str, weight: Column, top: int) -> DataFrame:
    """The heaviest groups by the first key, the second and both (grouping sets), ties by name; a top-k report."""
    view = rows.select(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"), weight.alias("w"))
    cube = view.cube("a", "b").agg(F.grouping_id("a", "b").alias("g"), F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("score")).filter("g <> 3")
    named = cube.select(F.when(F.col("g") == 1, first).when(F.col("g") == 2, second).otherwise(f"{first}+{second}").alias("grouping"), F.concat_ws("|", "a", "b").alias("name"), "n", "score")
    return named.orderBy(F.desc("score"), "grouping", "name").limit(top)


def weighted_verdict(before: DataFrame, after: DataFrame, weights: Mapping[str, float], lower_is_better: Sequence[str] = (), epsilon: float = 0.01, band: float = 0.25) -> DataFrame:
    """key, comparable, score, verdict of metrics (key, metric, value) of two phases.

    Each metric that moved by ``epsilon`` or more counts for or against with
    its weight (1 if none is given); the score is what speaks for less what
    speaks against, over both.  Fewer than two comparable metrics, or none that
    moved, tell nothing; and no improvement is claimed where the metric of the
    highest weight got worse.
    """
    weight, primary = F.lit(1.0), max(weights, key=weights.get)
    for name, w in weights.items():
        weight = F.when(F.col("metric") == name, w).otherwise(weight)
    both = before.withColumnRenamed("value", "old").join(after.withColumnRenamed("value", "new"), ["key", "metric"]).filter("old is not null and new is not null")
    change = both.withColumn("delta", F.round(F.col("new") - F.col("old"), 4)).withColumn("impact", F.abs("delta") * weight)
    moved = F.abs("delta") >= epsilon
    better = moved & (F.when(F.col("metric").isin(*lower_is_better), -F.col("delta")).otherwise(F.col("delta")) > 0)
    total = lambda flag: F.sum(F.when(flag, F.col("impact")).otherwise(0.0))
    sums = change.groupBy("key").agg(F.count("*").alias("comparable"), F.count_if(moved).alias("moved"), total(better).alias("gain"), total(moved & ~better).alias("loss"), F.bool_or(moved & ~better & (F.col("metric") == primary)).alias("primary_worse"))
    score = F.when(F.col("gain") + F.col("loss") > 0, F.round((F.col("gain") - F.col("loss")) / (F.col("gain") + F.col("loss")), 4)).otherwise(0.0)
    verdict = (
        F.when((F.col("comparable") < 2) | (F.col("moved") == 0), "INCONCLUSIVE")
        .when((F.col("score") >= band) & F.col("primary_worse"), "INCONCLUSIVE")
        .when(F.col("score") >= band, "IMPROVED")
        .when(F.col("score") <= -band, "REGRESSED")
        .otherwise("INCONCLUSIVE")
    )
    return sums.withColumn("score", score).select("key", "comparable", "score", verdict.alias("verdict"))


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule; a null condition breaks none."""
    return filter_counts(rows, {name: F.coalesce(~c, F.lit(False)) for name, c in rules.items()}).withColumnRenamed("filter", "rule")
