"""Detected events against a ground truth: counts by day, rates over all, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that are compared, and the gate's limits: recall, precision, least field accuracy, most human touch.
FIELDS = ("date", "time", "fee", "venue")
PASS = (0.85, 0.99, 0.98, 0.20)
CONDITIONAL = (0.80, 0.99, 0.98, 0.25)
# What is counted of a found row, each a bit of one number.
MARKS = ("told", "verified", "cancelled", "touched", "hallucinated", "cancel_miss")


def _normal(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def _marked(found: DataFrame) -> DataFrame:
    """gt_id, day, marks and read: the marks of a row as bits, and its fields where they are compared, so that little is sorted for each row."""
    status = F.col("status")
    said = {"told": status.isNotNull(), "verified": status == "VERIFIED", "cancelled": status == "CANCELLED"}
    marks = sum((F.when(said.get(m, F.col(m)), 1 << k).otherwise(0) for k, m in enumerate(MARKS)), F.lit(0))
    return found.select("gt_id", "day", marks.alias("marks"), F.when(said["verified"], F.struct(*[f"f_{f}" for f in FIELDS])).alias("read"))


def compared(truth: DataFrame, found: DataFrame) -> DataFrame:
    """day, and counts of a day: truths, detected, verified, correct, false, field matches, touches, hallucinated, cancellation misses.

    ``truth`` has gt_id, day, status (HELD, CANCELLED) and g_date, g_time,
    g_fee, g_venue; ``found`` gt_id, day, status, f_date, ..., touched,
    hallucinated, cancel_miss.  A row counts for its truth's id on its truth's
    day; a cancelled truth that no row calls cancelled is a miss.
    """
    keys = ["gt_id", "day"]
    rows = truth.withColumnRenamed("status", "actual").join(_marked(found), keys, "left")
    has = {m: F.coalesce(F.col("marks").bitwiseAND(1 << k) != 0, F.lit(False)) for k, m in enumerate(MARKS)}
    verified = has["verified"]
    match = {f: _normal(F.col(f"read.f_{f}")) == _normal(F.col(f"g_{f}")) for f in FIELDS}
    right = (F.col("actual") == "HELD") & match["date"] & match["time"] & match["fee"] & match["venue"]
    count = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    # in the join's order of keys, so that its rows are not sorted again
    per_truth = rows.groupBy(*keys).agg(
        (F.count_if(has["told"]) > 0).cast("long").alias("detected"), count(verified, "verified"), count(verified & right, "correct"), *[count(verified & match[f], f) for f in FIELDS],
        count(has["touched"], "touches"), count(has["hallucinated"], "hallucinated"),
        (F.count_if(has["cancel_miss"]) + F.when((F.max("actual") == "CANCELLED") & (F.count_if(has["cancelled"]) == 0), 1).otherwise(0)).alias("misses"),
    )
    counts = ("detected", "verified", "correct", *FIELDS, "touches", "hallucinated", "misses")
    return per_truth.groupBy("day").agg(F.count("*").alias("truths"), *[F.sum(c).alias(c) for c in counts]).withColumn("false_verified", F.col("verified") - F.col("correct"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def judged(days: DataFrame) -> DataFrame:
    """One row of all days: recall, precision, the accuracy of each field, human_touch, false_verified, hallucinated, misses, gate.

    Nothing false, invented or missed is tolerated; beyond that the gate
    passes, or passes conditionally, by its limits.
    """
    sums = days.agg(*[F.sum(c).alias(c) for c in ("truths", "detected", "verified", "correct", *FIELDS, "touches", "hallucinated", "misses", "false_verified")])
    rate = sums.select("*", _ratio(F.col("detected"), F.col("truths")).alias("recall"), _ratio(F.col("correct"), F.col("verified")).alias("precision"), *[_ratio(F.col(f), F.col("verified")).alias(f"{f}_accuracy") for f in FIELDS], _ratio(F.col("touches"), F.greatest("detected", F.lit(1))).alias("human_touch"))
    worst = F.coalesce(F.least(*[F.col(f"{f}_accuracy") for f in FIELDS]), F.lit(1.0))
    within = lambda limits: (F.coalesce("recall", F.lit(0.0)) >= limits[0]) & (F.coalesce("precision", F.lit(0.0)) >= limits[1]) & (worst >= limits[2]) & (F.coalesce("human_touch", F.lit(0.0)) <= limits[3])
    gate = F.when((F.col("false_verified") > 0) | (F.col("hallucinated") > 0) | (F.col("misses") > 0), "FAIL").when(within(PASS), "PASS").when(within(CONDITIONAL), "CONDITIONAL_PASS").otherwise("FAIL")
    return rate.select("recall", "precision", *[f"{f}_accuracy" for f in FIELDS], "human_touch", "false_verified", "hallucinated", "misses", gate.alias("gate"))
