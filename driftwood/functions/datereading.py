"""Dates in running text, read from its numbers and what stands between them.

A text is cut once into its runs of digits and the gaps around them.  Readings
look at a number, its width, and the next few gaps: whether they are one sign
that joins, a sign of what is counted, or the dash of a range.  No text is
matched against forms of whole dates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Months as English text writes them, in full or by three letters (September also by four).
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Words shortly after a date that make it a deadline.
DEADLINE = re.compile(r"[ \t\n\r\f\v]*\(?.{0,6}(?:까지|마감|until|deadline)")
BLANKS = " \t\n\r\f\v 　"
_DIGITS = re.compile("[0-9]+")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_MONTHS = {short: k for k, name in enumerate(MONTH_NAMES, 1) for short in {name, name[:3]}} | {"sept": 9}

#: A reading's year (None: not stated), month and day, and where it ends.
Reading = tuple[int | None, int, int, int]


class Numbers:
    """The digit runs of a text and the gaps after them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = [m.span() for m in _DIGITS.finditer(text)]
        ends = [start for start, _ in self.at[1:]] + [len(text)]
        self.gaps = [text[end:until] for (_, end), until in zip(self.at, ends)]
        # readings look at most three numbers ahead
        self.short = [end - start <= 2 for start, end in self.at] + [False] * 3

    def small(self, *places: int) -> bool:
        """Whether there are such numbers, of one or two digits each."""
        for k in places:
            if not self.short[k]:
                return False
        return True

    def value(self, k: int) -> int:
        return int(self.text[slice(*self.at[k])])

    def year(self, k: int) -> int | None:
        """A number of this century's years."""
        start, end = self.at[k]
        return self.value(k) if end - start == 4 and self.text.startswith("20", start) else None

    def short_year(self, k: int) -> int | None:
        start, end = self.at[k]
        return 2000 + self.value(k) if end - start == 2 else None

    def joined(self, k: int, signs: str) -> bool:
        """Whether a single sign, and nothing else, stands after a number."""
        return len(self.gaps[k]) == 1 and self.gaps[k] in signs

    def between(self, k: int) -> str:
        """What stands after a number, blanks aside."""
        return self.gaps[k].strip(BLANKS)

    def sign_end(self, k: int, sign: str) -> int | None:
        """Where a sign that follows a number ends."""
        end = self.at[k][1]
        blanks = len(self.gaps[k]) - len(self.gaps[k].lstrip(BLANKS))
        return end + blanks + 1 if self.gaps[k][blanks : blanks + 1] == sign else None


def _range_of_stated_year(n: Numbers, k: int) -> Reading | None:
    year = n.year(k)
    if year and n.small(k + 1, k + 2, k + 3) and n.gaps[k] and not n.gaps[k].strip(BLANKS + "–—-") and n.joined(k + 1, "./") and n.between(k + 2) == "-":
        return year, n.value(k + 1), n.value(k + 2), n.at[k + 3][1]
    return None


def _whole(year: Callable[[Numbers, int], int | None]) -> Callable[[Numbers, int], Reading | None]:
    def read(n: Numbers, k: int) -> Reading | None:
        stated = year(n, k)
        if stated is not None and n.small(k + 1, k + 2) and n.joined(k, "./-") and n.joined(k + 1, "./-"):
            return stated, n.value(k + 1), n.value(k + 2), n.at[k + 2][1]
        return None

    return read


def _counted(year: Callable[[Numbers, int], int | None]) -> Callable[[Numbers, int], Reading | None]:
    """Year, month and day, each with its sign."""

    def read(n: Numbers, k: int) -> Reading | None:
        stated = year(n, k)
        if stated is not None and n.between(k) == "년":
            rest = _day_of_month(n, k + 1) if k + 1 < len(n.at) else None
            return rest and (stated, *rest[1:])
        return None

    return read


def _day_of_month(n: Numbers, k: int) -> Reading | None:
    if n.small(k, k + 1) and n.between(k) == "월":
        end = n.sign_end(k + 1, "일")
        return end and (None, n.value(k), n.value(k + 1), end)
    return None


def _days_of_month(n: Numbers, k: int) -> Reading | None:
    """Several days of one month, the sign after the last; the first counts."""
    if n.small(k, k + 1, k + 2) and n.between(k) == "월":
        signs = n.between(k + 1).removeprefix("일").strip(BLANKS)
        end = n.sign_end(k + 2, "일")
        return (None, n.value(k), n.value(k + 1), end) if end and len(signs) == 1 and signs in ",，·&~-" else None
    return None


def _english_range(n: Numbers, k: int) -> Reading | None:
    """Days of an English month, as a range; the year may follow."""
    dash = n.between(k)
    if not (n.small(k, k + 1) and 1 <= n.value(k) <= 31 and 1 <= n.value(k + 1) <= 31 and len(dash) == 1 and (dash in "~-" or "‐" <= dash <= "―")):
        return None
    before = n.text[: n.at[k][0]].rstrip(BLANKS)[-12:].lower().removesuffix(".")
    word = before[len(before.rstrip("".join(_LETTERS))) :]
    if word not in _MONTHS:
        return None
    end, year = n.at[k + 1][1], None
    if k + 2 < len(n.at) and n.between(k + 1) in ("", ","):
        year = n.year(k + 2)
        end = n.at[k + 2][1] if year else end
    return year, _MONTHS[word], n.value(k), end


def _bare(n: Numbers, k: int) -> Reading | None:
    return (None, n.value(k), n.value(k + 1), n.at[k + 1][1]) if n.small(k, k + 1) and n.joined(k, "./") else None


#: Readings by how far they are trusted (fixed order): a later one counts only where no earlier one stands anywhere in the text.
BY_TRUST = (_range_of_stated_year, _whole(Numbers.year), _whole(Numbers.short_year), _counted(Numbers.year), _counted(Numbers.short_year), _day_of_month, _days_of_month, _english_range, _bare)

_BLANK = f"[{BLANKS}]*"
_MONTH = "|".join(name[:3] for name in MONTH_NAMES)
#: What a text must hold for each of these readings: without it no number of the text is looked at.
NEEDED = tuple(
    re.compile(form)
    for form in (
        "20[0-9][0-9](?s:.)*-", "20[0-9][0-9][./-][0-9]{1,2}[./-][0-9]", "[0-9][0-9][./-][0-9]{1,2}[./-][0-9]", f"20[0-9][0-9]{_BLANK}년", f"[0-9][0-9]{_BLANK}년",
        f"[0-9]{_BLANK}월", f"[0-9]{_BLANK}월", rf"(?i)(?:{_MONTH})[a-z]*\.?{_BLANK}[0-9]", "[0-9][./][0-9]",
    )
)


def readings(text: str) -> Iterator[Reading]:
    """All readings of a text, the trusted ones first, each kind from left to right; deadlines are none."""
    numbers = Numbers(text)
    for read, needed in zip(BY_TRUST, NEEDED, strict=True):
        for k in range(len(numbers.at)) if needed.search(text) else ():
            found = read(numbers, k)
            if found and not DEADLINE.match(text, found[3]):
                yield found


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("year", "month", "day")]))
def stated_date(texts: pd.Series) -> pd.DataFrame:
    """year, month and day of a text's most trusted reading; month null without one, year null where it states none."""
    first = [next(readings(t), (None, None, None, 0))[:3] if t else (None, None, None) for t in texts]
    return pd.DataFrame(first, columns=["year", "month", "day"]).astype("Int32")
