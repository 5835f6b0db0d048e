"""Dates from numbers and gaps: each reading, its neighbours, and the order of trust."""

import random

import pytest

from driftwood.functions.datereading import BY_TRUST, Numbers, readings


@pytest.mark.parametrize(
    "text, first",
    [
        ("gig 2031.7.9 here", (2031, 7, 9)),
        ("31-7-9", (2031, 7, 9)),
        ("2031/07/09", (2031, 7, 9)),
        ("2031년 7월 9일", (2031, 7, 9)),
        ("31년7월9일", (2031, 7, 9)),
        ("2031 7.9 - 11", (2031, 7, 9)),
        ("7월 9일", (None, 7, 9)),
        ("7월 9, 10일", (None, 7, 9)),
        ("7월 9일~10일", (None, 7, 9)),
        ("Sept. 3 – 5, 2031", (2031, 9, 3)),
        ("JUL 3-5", (None, 7, 3)),
        ("on 7/9", (None, 7, 9)),
        # a number that runs on is no day, a joined word no month, a lone English day no range
        ("2031.7.912", None),
        ("xjul 3-5", None),
        ("july 3", None),
        ("July 33-35", None),
        ("120.5", None),
        ("no numbers", None),
        ("", None),
    ],
)
def test_one_reading(text, first):
    assert next((r[:3] for r in readings(text)), None) == first


def test_trusted_readings_win_wherever_they_stand():
    text = "7/8, then 7월 9일, or 2031.7.10"
    assert [r[:3] for r in readings(text)][:3] == [(2031, 7, 10), (None, 7, 9), (None, 7, 8)]


def test_deadlines_are_passed_over():
    assert next(readings("until 2031.5.1 (목) 마감 2031.5.4"))[:3] == (2031, 5, 4)
    assert not list(readings("5월 1일까지")) and next(readings("5월 1일 is far from until"))[:3] == (None, 5, 1)


def test_every_reading_is_within_the_text_and_long_texts_cost_in_proportion():
    rnd = random.Random(1)
    parts = ["2031", "31", "7", "09", "123", ".", "/", "-", "년", "월", "일", " ", "may ", "~", ","]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        for year, month, day, end in readings(text):
            assert 0 < end <= len(text) and 0 <= month <= 99 and 0 <= day <= 99 and (year is None or 2000 <= year <= 2099)
    many = "12 seats, " * 50_000
    assert len(Numbers(many).at) == 50_000 and not list(readings(many)) and len(BY_TRUST) == 9


def test_no_number_is_looked_at_for_readings_that_a_text_cannot_hold(monkeypatch):
    from driftwood.functions import datereading

    assert len(datereading.NEEDED) == len(BY_TRUST)
    rnd = random.Random(3)
    bits = ["2031", "31", "7", "9", "10", ".", "/", "-", "년", "월", "일", " ", ",", "~", "–", "SEPT", "Jul", "may", "까지", "x", "\n", "120"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(12))) for _ in range(20000)]
    found = [list(readings(t)) for t in texts]
    assert {read for t in texts for read, needed in zip(BY_TRUST, datereading.NEEDED) if not needed.search(t)} == set(BY_TRUST)
    monkeypatch.setattr(datereading, "NEEDED", [datereading._DIGITS] * len(BY_TRUST))
    assert [list(readings(t)) for t in texts] == found and sum(map(bool, found)) > 100
