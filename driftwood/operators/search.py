"""Event search, its facets and calendar.

Events carry event_id, event_date, end_date (null: one day), start_min (minutes
of the day, null: unknown), genre, region, status, tier and canonical_id (null:
shown).  A filter that is None admits everything; an empty list admits nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that a search leaves out unless asked for.
OVER = ("CANCELLED", "COMPLETED")
TIERS = {"PRIMARY": 0, "OFFICIAL": 1, "COMMUNITY": 2}


def last_day() -> Column:
    return F.coalesce("end_date", "event_date")


def overlaps(first: dt.date, last: dt.date) -> Column:
    """Whether an event's period meets a window."""
    return (last_day() >= F.lit(first)) & (F.col("event_date") <= F.lit(last))


def chosen(column: Column, values: Sequence | None) -> Column:
    if values is None:
        return F.lit(True)
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)


def tier_rank() -> Column:
    rank = F.lit(len(TIERS))
    for name, k in TIERS.items():
        rank = F.when(F.col("tier") == name, k).otherwise(rank)
    return rank


def reading_order() -> list[Column]:
    return [F.asc("event_date"), F.asc_nulls_last("start_min"), tier_rank().asc(), F.asc("event_id")]


def matching(events: DataFrame, first: dt.date, last: dt.date, genres: Sequence | None = None, regions: Sequence | None = None, statuses: Sequence | None = None, more_genres: DataFrame | None = None) -> DataFrame:
    """Shown events whose period meets the window; a genre may be the event's own or one in ``more_genres`` (event_id, genre)."""
    found = events.filter(F.col("canonical_id").isNull() & overlaps(first, last)).filter(chosen(F.col("region"), regions))
    found = found.filter(~F.coalesce(F.col("status").isin(*OVER), F.lit(False)) if statuses is None else chosen(F.col("status"), statuses))
    if genres is None or more_genres is None:
        return found.filter(chosen(F.col("genre"), genres))
    extra = more_genres.filter(chosen(F.col("genre"), genres)).select(F.col("event_id"), F.lit(True).alias("_has")).distinct()
    return found.join(extra, "event_id", "left").filter(chosen(F.col("genre"), genres) | F.col("_has").isNotNull()).drop("_has")


def page(rows: DataFrame, size: int, number: int, order: list[Column] | None = None) -> DataFrame:
    """One page, from 1; a page before the first is the first."""
    return rows.orderBy(*(order or reading_order())).offset(size * (max(1, number) - 1)).limit(size)


def facet(rows: DataFrame, by: str, unknown: str = "UNKNOWN") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(by), F.lit(unknown)).alias(by)).agg(F.count("*").alias("n"))


def calendar(events: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """day, n for every day of the window: an event counts on each day of its period, days without events are 0."""
    on = events.filter(F.col("canonical_id").isNull() & ~F.coalesce(F.col("status") == "CANCELLED", F.lit(False)) & overlaps(first, last))
    days = on.select(F.explode(F.sequence(F.greatest("event_date", F.lit(first)), F.least(last_day(), F.lit(last)))).alias("day"))
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def presented(events: DataFrame) -> DataFrame:
    """Columns a reader sees: clock as HH:mm, labels of unknown things, null kept null."""
    clock = F.when(F.col("start_min").isNotNull(), F.format_string("%02d:%02d", F.floor(F.col("start_min") / 60) % 24, F.col("start_min") % 60))
    return events.withColumns({"clock": clock, "genre_label": F.coalesce("genre", F.lit("UNKNOWN")), "days": (F.datediff(last_day(), F.col("event_date")) + 1).cast("long")})


def redirected(ids: DataFrame, events: DataFrame) -> DataFrame:
    """asked, event_id: what each asked id leads to, a folded event to its canonical one; unknown ids lead nowhere."""
    found = ids.select(F.col("event_id").alias("asked")).join(events.select("event_id", "canonical_id"), F.col("asked") == F.col("event_id"))
    return found.select("asked", F.coalesce("canonical_id", "event_id").alias("event_id"))


def latest(rows: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, without a sort of whole groups where keys are few: a rank limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
