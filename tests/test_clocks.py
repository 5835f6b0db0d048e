"""Own ranges, start times, roles of days and ordinal weekdays on texts of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwood.functions import clocks

WORDS = "밀롱가|milonga"


def read(spark, text, use):
    return spark.createDataFrame([(text,)], "text string").select(use(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, start",
    [
        ("workshop PM 3:00~4:30\nmilonga PM 8:00~11:00", 1200),
        ("워크숍 PM 3:00~4:30 밀롱가", None),
        ("공연 PM 7:00~7:30 밀롱가 PM 8:00~11:00", 1200),
        ("PM 5:00~6:00 class", None),
        ("일시: 18:00 ~ 23:30\nmilonga 20:00 ~ 21:00", 1080),
        ("20:00 ~ 22:00, later PM 9:00 ~ PM 11:00", 1260),
        ("no clock at all", None),
        ("", None),
        (None, None),
    ],
)
def test_own_range(spark, text, start):
    found = read(spark, text, lambda t: clocks.own_range(t, WORDS))
    assert (found and found.start_min) == start


@pytest.mark.parametrize(
    "text, start",
    [
        ("lesson PM 7:00\nmilonga open PM 9:00", 1260),
        ("social until 05:00", None),
        ("PM 8:30\n19:45", None),
        ("doors 20시", 1200),
        ("at 7시", None),
        ("milonga 10시부터, 밤 9시", 1260),
        ("milonga PM 8:00~11:00", None),
        ("", None),
        (None, None),
    ],
)
def test_start_min(spark, text, start):
    assert read(spark, text, lambda t: clocks.start_min(t, WORDS)) == start


@pytest.mark.parametrize(
    "text, roles",
    [
        ("2026.6.3 접수 마감 2026.6.9", ["DEADLINE", "EVENT"]),
        ("예매 기간: 2026-10-01 ~ 2026-10-09\n2026-10-31", ["DEADLINE", "DEADLINE", "EVENT"]),
        ("deadline: 2026/10/01", ["DEADLINE"]),
        ("2026.10.22(목) 18:00까지", ["DEADLINE"]),
        ("2026.10.22 ~ 2026.10.25", ["EVENT", "EVENT"]),
        ("2026.13.45", []),
        ("", []),
    ],
)
def test_day_roles(spark, text, roles):
    assert [r.role for r in read(spark, text, clocks.day_roles)] == roles


@pytest.mark.parametrize(
    "text, day",
    [
        ("9월 둘째주 토요일", dt.date(2026, 9, 12)),
        ("1월 마지막 금요일", dt.date(2027, 1, 29)),
        ("9월 다섯째 토요일", None),
        ("13월 첫째 월요일", None),
        ("nothing", None),
    ],
)
def test_month_ordinal(spark, text, day):
    assert read(spark, text, lambda t: clocks.month_ordinal(t, F.lit("2026-09-01").cast("date"))) == day
