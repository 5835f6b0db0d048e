"""Text operators as column expressions: markup, addresses, keys, redaction."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Character references decoded in page text, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# What is taken out of public text, in this order, and its marks.
REDACTIONS = (
    (r"0[0-9]{1,2}[-\s.]?[0-9]{3,4}[-\s.]?[0-9]{4}", "[PHONE]"),
    (r"\b[0-9]{10,16}\b", "[ACCOUNT]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def decoded(text: Column) -> Column:
    for coded, plain in ENTITIES:
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def visible_text(html: Column) -> Column:
    """Text of a page: comments, scripts and styles dropped, tags to blanks, references decoded, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", " ")
    return squeezed(decoded(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")))


def page_title(html: Column) -> Column:
    """<title>, else og:title; null if neither says anything."""
    title = squeezed(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    social = squeezed(decoded(F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["'](.*?)["']""", 1)))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(social, F.lit("")))


def first_long_enough(least: int, *attempts: tuple[str, Column]) -> Column:
    """struct(text, method) of the first attempt whose text has ``least`` code points; null if none has."""
    return F.coalesce(*[F.when(F.length(text) >= least, F.struct(text.alias("text"), F.lit(name).alias("method"))) for name, text in attempts])


def article(html: Column, least: int = 20) -> Column:
    """The article cascade: <article>, <main>, paragraphs, whole page."""
    inside = lambda tag: visible_text(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    paragraphs = squeezed(F.array_join(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), visible_text), " "))
    return first_long_enough(least, ("ARTICLE", inside("article")), ("MAIN", inside("main")), ("PARAGRAPHS", paragraphs), ("PAGE", visible_text(html)))


def is_menu(text: Column, least_tokens: int = 40, most_mean: float = 6.0) -> Column:
    """Navigation rather than prose: many short tokens, without a digit or a full stop."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    total = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(t))
    return (F.size(tokens) >= least_tokens) & ~text.rlike("[0-9.]") & (total / F.greatest(F.size(tokens), F.lit(1)) <= most_mean)


def redacted(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, F.lit(mark.replace("$", r"\$")))
    return text


def redactions(text: Column) -> Column:
    """How many places ``redacted`` replaces: each pattern counts on what the earlier ones left."""
    total = F.lit(0)
    for pattern, mark in REDACTIONS:
        total = total + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, F.lit(mark))
    return total


def snippet(text: Column, most: int) -> Column:
    """Bold tags gone, references decoded, blanks squeezed, cut to ``most`` code points."""
    return F.left(squeezed(decoded(F.regexp_replace(text, r"(?i)</?b>", ""))), F.lit(most))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no query, fragment or trailing slash; null for what is no http address."""
    head = F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.regexp_replace(path, "/+$", "")))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^@/?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def is_public_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#\s]+\.[^/?#\s]+"), F.lit(False))


def map_url(base: str, address: Column) -> Column:
    """A map search for an address, blanks as %20."""
    return F.concat(F.lit(base), F.replace(F.url_encode(F.trim(address)), F.lit("+"), F.lit("%20")))


def csv_safe(value: Column) -> Column:
    """Guarded against being read as a formula by a spreadsheet."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def occurs_any(terms: Sequence[str], text: Column) -> Column:
    """Whether one of the terms occurs: a Latin one as a whole word, any other anywhere; case aside."""
    latin = [re.escape(t.lower()) for t in terms if t.isascii()]
    forms = [rf"(?<![a-z0-9])(?:{'|'.join(latin)})(?![a-z0-9])"] if latin else []
    forms += [re.escape(t.lower()) for t in terms if not t.isascii()]
    return F.lower(text).rlike("|".join(forms)) if forms else F.lit(False)


def occurs(term: str, text: Column) -> Column:
    """Whether a term occurs, as in ``occurs_any``."""
    return occurs_any([term], text)


@F.pandas_udf(StringType())
def folded_key(values: pd.Series) -> pd.Series:
    """NFKC, case folded, only letters and digits: the key under which names are compared.  Spark has no NFKC."""
    import unicodedata

    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKC", v).casefold() if c.isalnum()))


#: Letters from which difflib passes over the right text's popular letters, and from which measuring it so costs no more than bounding it.
LONG_TEXT = 200


def matched(left: str, right: str) -> int:
    """Letters in the blocks that difflib matches with a right text of LONG_TEXT and more.

    The longest run of letters that are rare on the right, the first of equals,
    is found among the places of two such letters (of one, if there are none),
    and grown by what stands beside it; so are the texts before and after it.
    """
    most = len(right) // 100 + 1
    rare = {c for c, n in Counter(right).items() if n <= most}.intersection(left)
    at: dict[str, list[int]] = {}
    twos: dict[str, list[int]] = {}
    before = -2
    for j, letter in enumerate(right):
        if letter in rare:
            at.setdefault(letter, []).append(j)
            if before == j - 1:
                twos.setdefault(right[before : j + 1], []).append(before)
            before = j
    ones = [i for i, letter in enumerate(left) if letter in rare]
    pairs = [(i, twos[left[i : i + 2]]) for i, after in zip(ones, ones[1:]) if after == i + 1 and left[i : i + 2] in twos]
    starts = [i for i, _ in pairs]
    total, open_ = 0, [(0, len(left), 0, len(right))]
    while open_:
        a, a_end, b, b_end = open_.pop()
        i, j, size = a, b, 0
        runs: dict[int, int] = {}
        last = -2
        for x, places in pairs[bisect_left(starts, a) : bisect_left(starts, a_end - 1)]:
            on = {} if x != last + 1 else runs
            runs, last = {}, x
            for y in places[bisect_left(places, b) : bisect_left(places, b_end - 1)]:
                n = runs[y] = on.get(y - 1, 1) + 1
                if n > size:
                    i, j, size = x - n + 2, y - n + 2, n
        if not size:
            for k in range(bisect_left(ones, a), bisect_left(ones, a_end)):
                places = at[left[ones[k]]]
                first = bisect_left(places, b)
                if first < len(places) and places[first] < b_end:
                    i, j, size = ones[k], places[first], 1
                    break
        while i > a and j > b and left[i - 1] == right[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_end and j + size < b_end and left[i + size] == right[j + size]:
            size += 1
        if size:
            total += size
            if a < i and b < j:
                open_.append((a, i, b, j))
            if i + size < a_end and j + size < b_end:
                open_.append((i + size, a_end, j + size, b_end))
    return total


def ratio(left: str, right: str) -> float:
    """difflib's ratio, whose search costs the product of the texts again for each block of long ones."""
    import difflib

    if len(right) < LONG_TEXT:
        return difflib.SequenceMatcher(None, left, right).ratio()
    return 2.0 * matched(left, right) / (len(left) + len(right))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, 0 where one is null; thresholds on it need this very measure."""
    return pd.Series([0.0 if a is None or b is None else ratio(a, b) for a, b in zip(left, right)])


def _in_both(left: str, right: str) -> int:
    """Length of the longest common subsequence: a row of the table is one integer, a bit a letter."""
    at: dict[str, int] = {}
    for i, letter in enumerate(left):
        at[letter] = at.get(letter, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for letter in right:
        if letter in at:
            met = row & at[letter]
            row = ((row + met) | (row - met)) & full
    return len(left) - row.bit_count()


@F.pandas_udf(DoubleType())
def most_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """What ``similarity`` cannot exceed, either way round, at a fraction of its cost: matches stand in order, so they are a common subsequence."""
    return pd.Series([0.0 if a is None or b is None else 2 * _in_both(a, b) / max(len(a) + len(b), 1) if a != b else 1.0 for a, b in zip(left, right)])
