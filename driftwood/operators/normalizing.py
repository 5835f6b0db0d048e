"""Candidates to events: what is derived, where from, and in which order of trust."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def genre(event_type: Column, board_named: Column, source_genre: Column, types: Mapping[str, str]) -> Column:
    """By the type of event; else the only genre that a board's post names; else the source's."""
    by_type = F.lit(None).cast("string")
    for name, g in types.items():
        by_type = F.when(event_type == name, g).otherwise(by_type)
    return F.coalesce(by_type, only(board_named), source_genre)


def only(found: Column) -> Column:
    """The element of an array that has exactly one distinct value."""
    distinct = F.array_distinct(F.array_compact(found))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def region(venue_region: Column, board_region: Column, structured: Column) -> Column:
    """The venue's; else that of an official board; else the only one that a structured listing names."""
    return F.coalesce(venue_region, board_region, only(structured))


def end_day_offset(offset: Column, end_min: Column, corrected: Column) -> Column:
    """Carried over, but no offset where a person corrected the end or there is none."""
    return F.when(end_min.isNull() | corrected, 0).otherwise(F.coalesce(offset, F.lit(0)))


def identity_key(day: Column, place: Column, start_min: Column) -> Column:
    """date|place|clock, blanks where one is not known."""
    return F.concat_ws("|", day.cast("string"), F.coalesce(place.cast("string"), F.lit("")), F.coalesce(start_min.cast("string"), F.lit("")))


def series_key(place: Column, day: Column, name: Column) -> Column:
    """place|weekday (Monday 0)|name, without the name's dates, weekdays and marks."""
    core = F.regexp_replace(F.lower(name), r"[0-9]{1,4}([./-][0-9]{1,2})*|(mon|tues|wednes|thurs|fri|satur|sun)day|[^\p{L}\p{N} ]", "")
    return F.concat_ws("|", F.coalesce(place.cast("string"), F.lit("")), F.weekday(day).cast("string"), F.trim(F.regexp_replace(core, " +", " ")))


def listing(canonical_id: Column, review: Column) -> Column:
    """A folded or refused row stays hidden, whatever comes in again."""
    return F.when(canonical_id.isNotNull() | F.coalesce(F.upper(review).isin("REJECTED", "DUPLICATE"), F.lit(False)), "HIDDEN").otherwise("LISTED")


def provenance(events: DataFrame, items: DataFrame) -> DataFrame:
    """event_id, item_id, provenance: the newest item of the event's address, LIVE or SNAPSHOT by how it was collected."""
    newest = items.groupBy("url").agg(F.max("item_id").alias("item_id"), F.max_by("mode", "item_id").alias("mode"))
    return events.join(newest, "url", "left").select("event_id", "item_id", F.when(F.col("mode") == "live", "LIVE").when(F.col("mode").isNotNull(), "SNAPSHOT").alias("provenance"))


def unresolved(texts: DataFrame) -> DataFrame:
    """key, text, n, last_day of place texts (text, day) that no place matched, one row for each spelling that normalises alike."""
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    return texts.withColumn("key", key).filter("key <> ''").groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("n"), F.max("day").alias("last_day"))


def metrics(events: DataFrame) -> DataFrame:
    """One row: events, and how many have a place, a region, a genre, a start, are folded or hidden."""
    has = lambda c: F.count(c).alias(c.replace("_id", ""))
    return events.agg(F.count("*").alias("events"), has("venue_id"), has("region"), has("genre"), F.count("start_min").alias("started"), F.count("canonical_id").alias("folded"), F.count_if(F.col("listing") == "HIDDEN").alias("hidden"))
