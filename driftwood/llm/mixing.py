"""Mixing sources to target weights over a time-varying curriculum.

Every source has a target of words and a schedule of relative weight over
training time 0..1.  The schedule's integral, scaled to the target, is the
source's cumulative demand.  A copy of a document that starts at word ``x`` of
the source's stream has the position at which demand reaches ``x``; the copies
whose position lies inside training are the ones taken, and they are
range-sorted by it.

A source's stream is its documents in the order of their ids' md5, repeated as
often as the target needs.  Places in the stream come from two levels of sums
(buckets, then inside buckets), so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

#: Weights dealt to the sources in the order of their names.
WEIGHTS = (5, 2, 1)
#: The most often a source's words may be taken.
MOST_REPEATS = 3
#: A stream's order is that of so many hexadecimal digits of the id's md5.
_ORDER_DIGITS = 15
#: Rows that one bucket of a source's stream holds, about.
BUCKET_ROWS = 5000
#: Schedules dealt in the same way: weight at the start, the middle and the end of training.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """Targets of sources from (source, source_size), one row each: adds nth, weight and target.

    Sources go by code point, null last, and take ``weights`` in turn.  Targets
    share the sum of all sizes by weight and stop at ``most`` times the source's
    size; what is over is shared again.  That ends where target = min(cap,
    weight * level): with sources in order of cap / weight, the capped ones are
    a prefix, and the level follows from sums over that prefix.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = sizes.withColumn("nth", (F.row_number().over(by_name) - 1).cast("long"))
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double"),
            "open_weight": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    # the first source under its cap fixes the level for itself and all after it
    listed = listed.withColumn("level", F.when(F.col("weight") * level < F.col("cap"), level))
    listed = listed.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return listed.select("source", "source_size", "nth", "weight", target.alias("target"))


def time_of_demand(share: Column, nth: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` (0..1) of its target.

    A schedule is linear between evenly spaced knots, so its integral is a
    quadratic on each segment, inverted in closed form.
    """
    chosen = F.lit(None).cast("double")
    for which, knots in enumerate(schedules):
        width = 1.0 / (len(knots) - 1)
        areas = [width * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        total = sum(areas)
        found = F.lit(1.0)
        done = total
        for k in reversed(range(len(areas))):
            done -= areas[k]
            a, slope = knots[k], (knots[k + 1] - knots[k]) / width
            rest = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))
            inside = rest / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            time = F.lit(k * width) + F.least(inside, F.lit(width))
            found = time if k == len(areas) - 1 else F.when(share * F.lit(total) < F.lit(done + areas[k]), time).otherwise(found)
        chosen = F.when(nth % len(schedules) == which, found).otherwise(chosen)
    return chosen


def _placed(docs: DataFrame, weights: Sequence[float], most: float, bucket_rows: int) -> DataFrame:
    """``docs`` (source, size, at, doc_id, tie and more) with source_size, nth, target and before: the words of the source's stream before the row.

    Read twice: once for sums, of source, size and at only.
    """
    light = stored(docs.select("source", "size", "at"), "sizes")
    per_source = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    targets = stored(targets.withColumnRenamed("source", "of").join(per_source, F.col("of").eqNullSafe(F.col("source"))).select("of", "nth", "weight", "target", "n", targets.source_size), "targets")

    # buckets are ranges of the hashed order, as many as the source's rows need
    share = F.col("at").cast("double") / F.lit(float(16**_ORDER_DIGITS))
    keyed = lambda rows: rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.floor(share * F.ceil(F.col("n") / F.lit(bucket_rows))).cast("long"))
    sums = keyed(light).groupBy("nth", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sums.select(F.col("nth").alias("s_nth"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")), "starts")
    inside = Window.partitionBy("nth", "bucket").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed(docs).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, (F.col("nth") == F.col("s_nth")) & (F.col("bucket") == F.col("s_bucket"))).withColumn("before", F.col("before") + F.col("base"))
    return placed.drop("s_nth", "s_bucket", "base", "bucket", "n", "weight", "at")


def _copies(most: float, schedules: Sequence[Sequence[float]], whole: bool) -> Column:
    """array<struct<position, words>> of a row's copies inside training, by position, from its size, before, source_size and target.

    The copy's position is where the demand of its source, inverted, reaches
    the copy's first word.  It takes its words up to the target; with ``whole``
    all of them, if its middle lies before the target.
    """
    goal = F.floor(F.col("target") + F.lit(1e-6)).cast("long")

    def copy(k: Column) -> Column:
        start = k * F.col("source_size") + F.col("before")
        left = goal - start
        words = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")) if whole else F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
        return F.struct(time_of_demand(start / F.col("target"), F.col("nth"), schedules).alias("position"), words.alias("words"))

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(int(-(-most // 1))).cast("long")), copy)
    return F.when(F.col("size") > 0, F.filter(every, lambda c: c.words > 0)).otherwise(F.array().cast("array<struct<position:double,words:bigint>>"))


def _order() -> Column:
    """The place of a row in its source's stream: digits of its id's md5, or of its text's where it has none."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), text_or_empty()))
    return F.conv(F.left(F.md5(key), F.lit(_ORDER_DIGITS)), 16, 10).cast("long")


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, schedules: Sequence[Sequence[float]] = SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, copies, positions.

    ``size`` counts words (null text: 0).  ``positions`` are the times in
    training of the row's copies; ``taken`` is the sum of their words, so each
    source's sum is its target rounded down, and the last copy read may be cut.
    Documents without words are never taken.  A source of no words has target
    0.  Rows that repeat are rows of their own; rows that tie in id and text
    are alike, and share places in any order.  No rows in: no rows out.  Other
    columns play no part.
    """
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"), _order().alias("at"), F.xxhash64("text").alias("tie")), "sized")
    placed = _placed(sized, weights, most, bucket_rows).withColumn("taken_copies", _copies(most, schedules, False))
    taken = F.aggregate("taken_copies", F.lit(0).cast("long"), lambda s, c: s + c.words)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.size("taken_copies").cast("long").alias("copies"), F.col("taken_copies.position").alias("positions"))


def by_position(mixed: DataFrame) -> DataFrame:
    """A mixture's rows range-sorted by their first position, those never taken last."""
    first = F.get("positions", F.lit(0))
    return mixed.withColumn("first_position", first).repartitionByRange(F.asc_nulls_last("first_position"), F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("first_position"), F.asc_nulls_last("doc_id"))


def training_order(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, schedules: Sequence[Sequence[float]] = SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it has copies, range-sorted by training position.

    Copies are whole: one is taken if its middle lies before the target.
    Columns are those of ``docs``; every row goes through the plan itself, so
    rows that repeat are rows of their own.  Equal positions go by doc_id.
    """
    # the documents' own columns travel in one, so that any names will do
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count().alias("size"), _order().alias("at"), F.xxhash64("text").alias("tie"))
    placed = _placed(rows, weights, most, bucket_rows).select("row", "doc_id", F.explode(_copies(most, schedules, True)).alias("copy"))
    return placed.repartitionByRange("copy.position", "doc_id").sortWithinPartitions("copy.position", "doc_id").select("row.*")
