"""Summaries of sources, reviews, evidence and yield: one grouping each, filters inside the aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tagging import occurrences


def windowed_grid(events: DataFrame, rows: str, columns: str, day: str, today: Column, windows: Mapping[str, int]) -> DataFrame:
    """rows, columns and a count of events of the next so many days for each window; pairs without any stand with zeros.

    The grid is spanned by the distinct labels, so it stays as small as they are.
    """
    ahead = F.datediff(day, today)
    counted = events.groupBy(rows, columns).agg(*[F.count_if(ahead.between(0, n)).alias(name) for name, n in windows.items()])
    grid = events.select(rows).distinct().crossJoin(events.select(columns).distinct())
    return grid.join(counted, [rows, columns], "left").fillna(0, list(windows))


def breakdown(items: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """source, items, fetched, events, listed: two groupings joined, so that neither multiplies the other."""
    a = items.groupBy(source).agg(F.count("*").alias("items"), F.count_if(F.col("status").startswith("FETCHED")).alias("fetched"))
    b = events.groupBy(source).agg(F.count("*").alias("events"), F.count_if(F.col("listing") == "LISTED").alias("listed"))
    return a.join(b, source, "full").fillna(0, ["items", "fetched", "events", "listed"])


def diagnosis(items: Column, fetched: Column, events: Column, upcoming: Column) -> Column:
    """Where a source loses its yield; the first step that lets nothing through."""
    return (
        F.when(items == 0, "NOTHING_FOUND")
        .when(fetched == 0, "NOTHING_FETCHED")
        .when(fetched < items * 0.5, "MOSTLY_BLOCKED")
        .when(events == 0, "NOTHING_EXTRACTED")
        .when(upcoming == 0, "ONLY_PAST")
        .otherwise("YIELDING")
    )


def evidence_clusters(evidence: DataFrame, key: str, day: str) -> DataFrame:
    """key, first_day, items, kinds, severity of evidence (kind, critical) grouped by key: several kinds confirm each other."""
    grouped = evidence.groupBy(key).agg(F.min(day).alias("first_day"), F.count("*").alias("items"), F.count_distinct("kind").alias("kinds"), F.bool_or("critical").alias("critical"))
    severity = F.when(F.col("critical") & (F.col("kinds") >= 2), "CRITICAL").when(F.col("critical") | (F.col("kinds") >= 3), "HIGH").when(F.col("items") >= 3, "MEDIUM").otherwise("LOW")
    return grouped.select(key, "first_day", "items", "kinds", severity.alias("severity"))


def review_metrics(reviews: DataFrame, by: Sequence[str], today: Column) -> DataFrame:
    """For each of ``by``: all, today, and the mean hours from being queued to being decided (at, queued_at)."""
    hours = (F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.col("queued_at").cast("timestamp"))) / 3600.0
    return reviews.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.to_date("at") == today).alias("today"), F.round(F.avg(hours), 6).alias("mean_hours"))


def backlog(hotspots: DataFrame, most: int) -> DataFrame:
    """rank, name, epic, urgency of the ``most`` hotspots (name, field, n, severe) with most behind them."""
    weight = F.col("n") + 2 * F.col("severe")
    top = hotspots.withColumn("weight", weight).orderBy(F.desc("weight"), "name").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "name"))
    urgency = F.when(F.col("severe") * 4 > F.col("n"), "P0").when(F.col("weight") >= 1000, "P1").otherwise("P2")
    return top.select(rank.cast("long").alias("rank"), "name", F.concat(F.lit("IMPROVE_"), F.upper("field")).alias("epic"), "weight", urgency.alias("urgency"))


def latest_routes(routes: DataFrame, trigger: str, order: Sequence[str]) -> DataFrame:
    """One row: triggers, routed, rate, by the latest route of each trigger (status)."""
    latest = routes.groupBy(trigger).agg(F.max_by("status", F.struct(*order)).alias("status"))
    return latest.agg(F.count("*").alias("triggers"), F.count_if(F.col("status") == "ROUTED").alias("routed")).withColumn("rate", F.when(F.col("triggers") > 0, F.round(F.col("routed") / F.col("triggers"), 4)))


def best_routes(failing: DataFrame, candidates: DataFrame, key: str, most: int = 2) -> DataFrame:
    """source, alternative, nth: the best ``most`` other sources that share a failing source's key, by reliability, then id.

    ``failing`` has source and the key, ``candidates`` alternative, the key and
    reliability.  A key's best few are kept first, so that a common key does
    not pair all its sources with each other.
    """
    best = Window.partitionBy(key).orderBy(F.desc("reliability"), "alternative")
    few = candidates.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= most + 1)
    paired = failing.join(few, key).filter("source <> alternative")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("reliability"), "alternative"))
    return paired.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= most).select("source", "alternative", "nth")


def keyword_profile(words: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """key, keywords: the first ``most`` distinct words (word) of a key in order."""
    first = words.groupBy(key, "word").agg(F.min(order).alias("_at"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_at", "word"))
    kept = first.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "word"))), lambda s: s.word), ",").alias("keywords"))


def mentions(texts: DataFrame, places: DataFrame) -> DataFrame:
    """text_id, place, agreed of texts (text_id, text, region, genre) that hold a place's name (place, name, p_region, p_genre) run together.

    All names are searched at once; a text meets only the places that it names.
    A match counts where region or genre agrees.  Texts are dealt out before
    they are searched: a small file of texts can name very many places.  They
    are then dealt by range of name, so that a task has few names, whose places
    repeat and so take little room where they are written.
    """
    together = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    named = places.withColumn("_name", together("name")).filter("_name <> ''")
    names = named.select(F.col("_name").alias("letters")).distinct().select(F.lit(0).alias("pattern"), "letters", F.lit(None).alias("scope"))
    whole = texts.select(F.col("text_id").alias("key"), together("text").alias("text"), "region", "genre").repartition("key")
    found = F.array_distinct(F.transform("hits", lambda h: F.substr("text", h.start + 1, h.end - h.start)))
    held = occurrences(whole, names, whole_words=False).select("key", "region", "genre", F.explode(found).alias("_name"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = held.repartitionByRange(parts, "_name", "key").join(named, "_name")
    agreed = F.coalesce(F.col("region") == F.col("p_region"), F.lit(False)) | F.coalesce(F.col("genre") == F.col("p_genre"), F.lit(False))
    return met.select(F.col("key").alias("text_id"), "place", agreed.alias("agreed"))
