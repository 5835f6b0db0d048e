"""Sources, what they bring, and why a place has nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(sources: DataFrame, runs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """source_id, last_run, last_ok, streak, items, fresh_hours of every source; sources never run keep nulls and zeros.

    ``runs`` has source_id, at, run_id, ok; ``items`` source_id.  Every part is
    aggregated by source before it is joined, so nothing fans out.
    """
    newest = Window.partitionBy("source_id").orderBy(F.desc("at"), F.desc("run_id")).rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("_passed", F.sum(F.col("ok").cast("int")).over(newest))
    by_run = marked.groupBy("source_id").agg(F.max("at").alias("last_run"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"), F.count_if(F.col("_passed") == 0).alias("streak"))
    by_item = items.groupBy("source_id").agg(F.count("*").alias("items"))
    joined = sources.select("source_id").join(by_run, "source_id", "left").join(by_item, "source_id", "left")
    hours = F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("last_ok"))) / 3600).cast("long")
    return joined.select("source_id", "last_run", "last_ok", F.coalesce("streak", F.lit(0)).alias("streak"), F.coalesce("items", F.lit(0)).alias("items"), hours.alias("fresh_hours"))


def zero_reasons(groups: DataFrame) -> DataFrame:
    """place, reason for places with no upcoming events: a failing collector that served it, no source, unattributed events, or none listed."""
    reason = (
        F.when(F.col("failing") & (F.col("served") > 0), "COLLECTOR_FAILING")
        .when(F.col("sources") == 0, "NO_SOURCE")
        .when(F.col("unattributed") > 0, "UNATTRIBUTED")
        .otherwise("NONE_LISTED")
    )
    return groups.filter(F.coalesce("upcoming", F.lit(0)) == 0).select("place", reason.alias("reason"))


def recommended(sources: DataFrame) -> DataFrame:
    """source_id, advice: watch what is off or empty, replace or keep what is blocked by its alternatives, keep the rest active."""
    advice = (
        F.when(~F.col("enabled") | (F.col("items") == 0), "MONITOR")
        .when(F.col("blocked") == F.col("items"), F.when(F.col("alternatives") > 0, "REPLACE").otherwise("KEEP"))
        .when(F.col("events") == 0, "MONITOR")
        .otherwise("ACTIVE")
    )
    return sources.select("source_id", advice.alias("advice"))


def with_alternatives(sources: DataFrame, genre: str) -> DataFrame:
    """``sources`` with alternatives: how many other sources have the genre; counted once a genre, less oneself."""
    each = sources.groupBy(genre).agg(F.count("*").alias("_n"))
    return sources.join(each, genre, "left").withColumn("alternatives", F.coalesce(F.col("_n") - 1, F.lit(0))).drop("_n")


def least_of_union(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value: the least value over several tables; an OR-join written as a union."""
    both = parts[0].select(key, value)
    for p in parts[1:]:
        both = both.unionAll(p.select(key, value))
    return both.groupBy(key).agg(F.min(value).alias(value))


def revision_digest(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: count and order-free digest of a table, for telling whether master data changed.

    Rows are digested one by one and the digests summed, so no task sorts or
    joins the whole table into one string.
    """
    each = F.conv(F.left(F.md5(F.concat_ws("\x1f", key, *columns)), F.lit(12)), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.sum(each.cast("decimal(38,0)")).cast("string").alias("digest"))
