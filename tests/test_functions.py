import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwood.functions import dates, extraction, text
from driftwood.functions.numbers import failing, percentage, ratio, wilson_low

WED = dt.date(2026, 9, 16)


@pytest.mark.parametrize(
    "when, first, last",
    [
        ("today", WED, WED),
        ("tomorrow", dt.date(2026, 9, 17), dt.date(2026, 9, 17)),
        ("this_week", WED, dt.date(2026, 9, 20)),
        ("weekend", dt.date(2026, 9, 19), dt.date(2026, 9, 20)),
        ("upcoming", WED, dt.date(2026, 10, 16)),
    ],
)
def test_windows(when, first, last):
    assert dates.window(when, WED) == (first, last)


def test_weekend_asked_on_sunday_is_the_next():
    assert dates.window("weekend", dt.date(2026, 9, 20))[0] == dt.date(2026, 9, 26)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'date' if isinstance(v, dt.date) else 'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said, day",
    [
        ("BAL 2026 - 9.18-20", dt.date(2026, 9, 18)),
        ("26.9.16.정모", dt.date(2026, 9, 16)),
        ("2026년 2월 30일", None),
        ("1/3 파티", dt.date(2027, 1, 3)),
        ("9월 19,20일", dt.date(2026, 9, 19)),
        ("Oct 8-11, 2026", dt.date(2026, 10, 8)),
        ("신청 9월 18일까지, 행사 9월 25일", dt.date(2026, 9, 25)),
        ("다음 주 토요일", dt.date(2026, 9, 26)),
        ("이번주 월요일", None),
        ("recorded 2010.12", None),
        ("no date", None),
    ],
)
def test_event_dates(spark, said, day):
    published = dt.date(2026, 12, 20) if said.startswith("1/3") else WED
    assert one(spark, extraction.event_date(F.col("t"), F.col("p")), t=said, p=published) == day


def test_date_without_year_needs_publication(spark):
    rows = spark.createDataFrame([("9/25", None)], "t string, p date")
    assert rows.select(extraction.event_date(F.col("t"), F.col("p")).alias("x")).first()["x"] is None


@pytest.mark.parametrize(
    "said, reading",
    [
        ("PM 7:30~12:00", (1170, 0, 1, "PROPAGATED", False)),
        ("6:30-10:30pm", (1110, 1350, 0, "PROPAGATED", False)),
        ("저녁 8시~새벽 2시", (1200, 120, 1, "EXPLICIT", False)),
        ("20:00-24:00", (1200, 0, 1, "ABSENT", False)),
        ("8:00~11:00", (480, 660, 0, "ABSENT", True)),
        ("room 3 - 4", None),
    ],
)
def test_time_ranges(spark, said, reading):
    found = one(spark, extraction.time_range(F.col("t")), t=said)
    assert (tuple(found) if found else None) == reading


@pytest.mark.parametrize(
    "said, amount, options",
    [
        ("입장료 13,000원", 13000, "13000"),
        ("회비 8천원", 8000, "8000"),
        ("무료 입장", 0, "0"),
        ("입장료 15,000원 비용 20,000원", None, "15000/20000"),
        ("입장료 3,000원 할인", None, None),
        ("주차 7,000원", None, None),
    ],
)
def test_fees(spark, said, amount, options):
    found = one(spark, extraction.fee(F.col("t")), t=said)
    assert (found["amount"], found["options"]) == (amount, options) if found else options is None


def test_text_functions(spark):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>x()</script><p>Hello&nbsp;<b>you</b></p></body></html>"
    assert one(spark, text.visible_text(F.col("t")), t=html) == "A & B Hello you"
    assert one(spark, text.page_title(F.col("t")), t=html) == "A & B"
    assert one(spark, text.canonical_url(F.col("t")), t="HTTP://Ex.COM/a/b/?x=1#y") == "http://ex.com/a/b"
    assert one(spark, text.canonical_url(F.col("t")), t="ftp://x") is None
    assert one(spark, text.redacted(F.col("t")), t="call 010-1234-5678, 123456789012 or a.b@c.org") == "call [PHONE], [ACCOUNT] or [EMAIL]"
    assert one(spark, text.redacted(F.col("t")), t="desk 02-123-4567, no x1234567890123456 y") == "desk [PHONE], no x1234567890123456 y"
    assert one(spark, text.redactions(F.col("t")), t="call 010-1234-5678, 123456789012 or a.b@c.org") == 3
    assert one(spark, text.csv_safe(F.col("t")), t="=1+1") == "'=1+1"
    assert one(spark, text.map_url("https://m/?q=", F.col("t")), t="a b") == "https://m/?q=a%20b"
    assert one(spark, text.folded_key(F.col("t")), t="Ｃafé 1-2") == "café12"
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="tango bar", b="tango bar") == 1.0


def test_numbers(spark):
    assert one(spark, ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, percentage(F.col("a"), F.col("b")), a=1, b=8) == 12.0
    assert one(spark, wilson_low(F.col("a"), F.col("b")), a=0, b=0) == 0.0
    assert one(spark, failing((F.col("a") > 0, "A"), (F.lit(None).cast("boolean"), "B")), a=0) == ["B"]


def test_nth_weekday_that_a_month_lacks(spark):
    assert one(spark, dates.nth_weekday(F.col("d"), "SAT", 5), d=WED) is None
    assert one(spark, dates.nth_weekday(F.col("d"), "SAT", -1), d=WED) == dt.date(2026, 9, 26)
