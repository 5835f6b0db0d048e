"""Ordered rules that label addresses, errors and media."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host

# Words of an image's address or of the text beside it.
EVENT_WORDS = r"poster|flyer|schedule|milonga|party|festival|workshop|포스터|일정"
VENUE_WORDS = r"venue|interior|hall|studio|map|공간|내부"
BRAND_WORDS = r"icon|brand|profile|favicon"
RETRYABLE = ("NETWORK", "RATE_LIMITED")


def error_kind(status: Column, message: Column) -> Column:
    """struct(kind, retryable) of a failed request; the first rule that holds decides.

    Missing credentials come before any status; a malformed answer is told by
    its decoder's message and comes last.
    """
    said = F.lower(F.coalesce(message, F.lit("")))
    kind = (
        F.when(F.contains(said, F.lit("not set")), "CREDENTIALS_MISSING")
        .when(status == 401, "AUTH_FAILED")
        .when(status == 403, "ACCESS_DENIED")
        .when(status == 429, "RATE_LIMITED")
        .when(status.between(500, 599) | said.rlike("network error|timed out|timeout"), "NETWORK")
        .when(F.contains(said, F.lit("json")), "BAD_RESPONSE")
        .otherwise("UNKNOWN")
    )
    return F.struct(kind.alias("kind"), kind.isin(*RETRYABLE).alias("retryable"))


def media_kind(url: Column, text: Column, width: Column, height: Column) -> Column:
    """struct(kind, score) of an image by its address, the text beside it and its size.

    A logo that says so comes first; event words count but on a small square,
    which is held to be an icon; then venue words; then a small image of a brand.
    """
    address, beside = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    says = lambda words: address.rlike(words) | beside.rlike(words)
    square = F.coalesce((width <= 256) & (height <= 256) & (F.abs(width - height) <= 32), F.lit(False))
    small = F.coalesce((width <= 512) & (height <= 512), F.lit(False))
    made = lambda kind, score: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    return (
        F.when(F.contains(address, F.lit("logo")) | beside.rlike(r"\blogo\b"), made("LOGO", 0.98))
        .when(says(EVENT_WORDS), F.when(square, made("UNKNOWN", 0.45)).otherwise(made("EVENT_POSTER", 0.85)))
        .when(says(VENUE_WORDS), made("VENUE_IMAGE", 0.75))
        .when(address.rlike(BRAND_WORDS) & small, made("LOGO", 0.70))
        .otherwise(made("UNKNOWN", 0.20))
    )


def community_identity(url: Column) -> Column:
    """Which community an address belongs to: a cafe's or band's id where it has one, else its host."""
    cafe = F.regexp_extract(url, r"^(?i)https?://(?:m\.)?cafe\.[a-z]+\.(?:com|net)/([A-Za-z0-9_-]+)", 1)
    band = F.regexp_extract(url, r"^(?i)https?://(?:www\.)?band\.us/(?:band|@)/?([A-Za-z0-9_-]+)", 1)
    return F.when(cafe != "", F.concat(F.lit("cafe:"), F.lower(cafe))).when(band != "", F.concat(F.lit("band:"), F.lower(band))).otherwise(F.concat(F.lit("host:"), F.regexp_replace(host(url), r"^www\.", "")))


def half_day_apart(a: Column, b: Column) -> Column:
    """Whether two clocks differ by twelve hours: one of them likely read in the wrong half of the day."""
    return F.coalesce(F.abs(a - b) == 720, F.lit(False))


def timing(first: Column, last: Column, is_festival: Column, today: Column) -> Column:
    """UNKNOWN without a date (or a begun festival without an end), UPCOMING, ONGOING or PAST."""
    return (
        F.when(first.isNull(), "UNKNOWN")
        .when(first > today, "UPCOMING")
        .when(last.isNull() & is_festival & (first < today), "UNKNOWN")
        .when(F.coalesce(last, first) >= today, "ONGOING")
        .otherwise("PAST")
    )
