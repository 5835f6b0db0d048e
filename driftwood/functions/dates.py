"""Calendar arithmetic on columns and on the driver; "today" is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Windows a reader may ask for.
WINDOWS = ("today", "tomorrow", "this_week", "weekend", "upcoming")
#: How far a date without a year may lie from the day it was published.
NEAREST_YEAR_DAYS = 200
#: The longest period that one event may last.
PERIOD_DAYS = 31


def window(when: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a named window; this_week ends on Sunday, weekend is the next Saturday and Sunday."""
    day = dt.timedelta(days=1)
    if when == "today":
        return today, today
    if when == "tomorrow":
        return today + day, today + day
    if when == "this_week":
        return today, today + day * (6 - today.weekday())
    if when == "weekend":
        saturday = today + day * ((5 - today.weekday()) % 7)
        return saturday, saturday + day
    if when == "upcoming":
        return today, today + day * 30
    raise ValueError(f"no such window: {when}")


def local_day(ts, zone: str = "Asia/Seoul") -> Column:
    """The calendar day of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def nth_weekday(month: Column, weekday: str, n: int) -> Column:
    """The nth (or, for -1, last) such weekday of a date's month; null if the month has no nth one."""
    first = F.trunc(month, "MM")
    if n == -1:
        return F.next_day(F.date_sub(F.last_day(month), 7), weekday)
    found = F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))
    return F.when(F.trunc(found, "MM") == first, found)


def nearest_year(month: Column, day: Column, published: Column, most_days: int = NEAREST_YEAR_DAYS) -> Column:
    """The date of a month and day nearest to ``published``, the earlier on a tie; null if beyond ``most_days`` or without ``published``."""
    def best(stated: Column) -> Column:
        days = F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(stated.published) + k, stated.month, stated.day), "yyyy-MM-dd"))
        near = F.array_min(F.transform(F.filter(days, lambda d: d.isNotNull()), lambda d: F.struct(F.abs(F.datediff(d, stated.published)).alias("far"), d.alias("day"))))
        return let(near, lambda n: F.when(n.far <= most_days, n.day))

    return let(F.struct(month.alias("month"), day.alias("day"), published.alias("published")), lambda s: F.when(s.month.isNotNull() & s.day.isNotNull() & s.published.isNotNull(), best(s)))


def months_ago(day: Column, n: int) -> Column:
    """``n`` months earlier, clamped to the end of the month."""
    return F.add_months(day, -n)


def period_end(start: Column, end: Column, most_days: int = PERIOD_DAYS) -> Column:
    """``end`` where it lies 1..most_days after ``start``, else null."""
    return F.when(F.datediff(end, start).between(1, most_days), end)


def gap_days(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Days between two periods; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), F.datediff(b0, a1), F.datediff(a0, b1))
