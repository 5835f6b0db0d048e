"""Windows over logs of outcomes: streaks, trailing rows, limits, hysteresis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def failure_streak(log: DataFrame, key: str, newest_first: list[Column], ok: Column) -> DataFrame:
    """key, streak: how many of a key's newest rows in a row are not ok (0 if the newest is).

    A row belongs to the streak while no ok row is at or before it in order;
    counting ok rows up to each row tells that in one pass.
    """
    passed = F.sum(ok.cast("int")).over(Window.partitionBy(key).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return log.withColumn("_passed", passed).groupBy(key).agg(F.count_if(F.col("_passed") == 0).alias("streak"))


def trailing(log: DataFrame, key: str, order: list[Column], hit: Column, sizes: Sequence[int]) -> DataFrame:
    """``log`` with hits_n and rate_n over the last n rows of the key, this one included."""
    out = log
    for n in sizes:
        frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"hits_{n}", F.sum(hit.cast("long")).over(frame))
        out = out.withColumn(f"rate_{n}", F.round(F.col(f"hits_{n}") / F.count("*").over(frame), 4))
    return out


def recent_rates(log: DataFrame, key: str, newest_first: list[Column], hit: Column, sizes: Sequence[int]) -> DataFrame:
    """One row a key: rows and rate of hits among its newest n rows, for each n."""
    ranked = log.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))).filter(F.col("_rank") <= max(sizes))
    aggs = []
    for n in sizes:
        near = F.col("_rank") <= n
        aggs += [F.count_if(near).alias(f"rows_{n}"), F.round(F.count_if(near & hit) / F.count_if(near), 4).alias(f"rate_{n}")]
    return ranked.groupBy(key).agg(*aggs)


def rate_limited(log: DataFrame, key: str, seconds: Column, limits: Sequence[tuple[int, int]]) -> DataFrame:
    """``log`` with within_s (rows of the key in the last s seconds, this one included) and allowed: no limit (count, s) is passed."""
    out, allowed = log, F.lit(True)
    for most, span in limits:
        frame = Window.partitionBy(key).orderBy(seconds).rangeBetween(-(span - 1), 0)
        out = out.withColumn(f"within_{span}", F.count("*").over(frame))
        allowed = allowed & (F.col(f"within_{span}") <= most)
    return out.withColumn("allowed", allowed)


def repeats(log: DataFrame, keys: Sequence[str], order: list[Column], seconds: Column, span: int) -> DataFrame:
    """``log`` with duplicate: an equal row came at most ``span`` seconds before."""
    before = F.lag(seconds).over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("duplicate", F.coalesce(seconds - before <= span, F.lit(False)))


def ordinals(log: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """``log`` with ordinal (nth case of its keys) and recurrent (not the first)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return log.withColumn("ordinal", nth).withColumn("recurrent", F.col("ordinal") > 1)


def _alerted(key: str, at: str, threshold: int, cooldown: int, schema: StructType):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, count, told = object(), 0, None
        for batch in batches:
            runs, notices = [], []
            for k, seconds, failed in zip(batch[key], batch[at], batch["_fail"]):
                if k != own and not (pd.isna(k) and pd.isna(own)):
                    own, count, told = k, 0, None
                notice = None
                if failed:
                    count += 1
                    if told is None and count >= threshold:
                        notice, told = "ALERT", seconds
                    elif told is not None and seconds - told >= cooldown:
                        notice, told = "REMINDER", seconds
                else:
                    notice = "RECOVERED" if told is not None else None
                    count, told = 0, None
                runs.append(count)
                notices.append(notice)
            yield batch.assign(run=runs, alert=notices)[schema.names]

    return run


def alerts(log: DataFrame, key: str, order: list[Column], failing: Column, seconds: Column, threshold: int, cooldown: int = 6 * 3600) -> DataFrame:
    """``log`` with run (failures in a row so far) and alert.

    ALERT as a run reaches ``threshold``; REMINDER at the first failure
    ``cooldown`` seconds or more after the last notice; RECOVERED at the first
    success after an alert.  Each key is walked in ``order`` in one task, which
    holds a count and a time.
    """
    kept = log.withColumn("_fail", F.coalesce(failing, F.lit(False))).withColumn("_at", seconds.cast("long"))
    schema = StructType([*log.schema.fields, StructField("run", LongType()), StructField("alert", StringType())])
    return kept.repartition(key).sortWithinPartitions(key, *order).mapInPandas(_alerted(key, "_at", threshold, cooldown, schema), schema)


def spans_of(rows: DataFrame, key: str, order: list[Column], label: Column) -> DataFrame:
    """``rows`` with part: the number of the run of equal labels a row is in, from 1, by key; how a text's segments change."""
    window = Window.partitionBy(key).orderBy(*order)
    changed = (~label.eqNullSafe(F.lag(label).over(window))) | F.lag(F.lit(1)).over(window).isNull()
    out = rows.withColumn("_new", changed.cast("int"))
    return out.withColumn("part", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_new")


def counted_within(rows: DataFrame, key: str, at: str, length: int, name: str) -> DataFrame:
    """``rows`` with how many of the key's rows lie in [at - length, at], the row and its peers included; rows without ``at`` count each other.

    A sliding frame is summed anew for every row.  Here time is cut into
    buckets of ``length``, and each row comes again one bucket on, at the moment
    it leaves the frame: so a running count is enough, and a key is spread over
    its buckets.
    """
    start = F.col(at) - F.pmod(F.col(at), F.lit(length))
    own = rows.withColumn("_bucket", start).withColumn("_gone", F.lit(0))
    gone = own.filter(F.col(at).isNotNull()).withColumns({at: F.col(at) + length, "_bucket": F.col("_bucket") + length, "_gone": F.lit(1)})
    bucket = Window.partitionBy(key, "_bucket")
    # what leaves at a row's own moment stands behind the row, and is still counted
    running = bucket.orderBy(at, "_gone").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("_gone").over(bucket) - F.sum("_gone").over(running)
    counted = own.unionByName(gone).withColumn(name, F.count_if(F.col("_gone") == 0).over(running) + left)
    return counted.filter("_gone = 0").drop("_bucket", "_gone")
