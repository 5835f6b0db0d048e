"""A place string taken apart: its name, an address in brackets, other names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# First-level regions as addresses begin with them, and the endings of roads, streets and districts before a number.
REGIONS = (
    "서울특별시", "서울", "부산광역시", "부산", "대구광역시", "대구", "인천광역시", "인천", "광주광역시", "광주", "대전광역시", "대전", "울산광역시", "울산", "세종특별자치시", "세종",
    "경기도", "경기", "강원특별자치도", "강원도", "강원", "충청북도", "충북", "충청남도", "충남", "전라북도", "전북", "전라남도", "전남", "경상북도", "경북", "경상남도", "경남", "제주특별자치도", "제주",
)
ROADS = ("로", "길", "가", "동", "읍", "면", "리")
# A metropolitan city that shares its short name with another, and its own districts.
SHARED_NAME, OWN_DISTRICTS = "광주", ("동구", "서구", "남구", "북구", "광산구")
_OPEN, _CLOSE = "(（", ")）"


def address_like(text: Column) -> Column:
    """A region at the front, or a road with a number: an address rather than a name."""
    return F.coalesce(text.rlike(rf"^\s*(?:{'|'.join(REGIONS)})(?![가-힣A-Za-z0-9_])") | text.rlike(rf"[가-힣A-Za-z0-9](?:{'|'.join(ROADS)})\s*\d"), F.lit(False))


def region_of(address: Column) -> Column:
    """The region an address begins with; the shared name only where the address itself tells which city it is."""
    head = F.nullif(F.regexp_extract(address, rf"^\s*({'|'.join(REGIONS)})", 1), F.lit(""))
    told = address.rlike(rf"^\s*{SHARED_NAME}\s+(?:{'|'.join(OWN_DISTRICTS)})")
    return F.when((head != SHARED_NAME) | told, head)


def trailing_groups(raw: str) -> tuple[str, list[str]]:
    """What stands before the brackets that a string ends with, and what each holds, inner brackets and all; ("", []) if they do not pair."""
    opened: list[int] = []
    groups: list[tuple[int, int]] = []
    text = raw.rstrip()
    for at, letter in enumerate(text):
        if letter in _OPEN:
            opened.append(at)
        elif letter in _CLOSE:
            # one that closes nothing leaves all before it outside
            groups.append((opened.pop() if opened else -1, at))
    by_end = {end: start for start, end in groups}
    held: list[str] = []
    end = len(text)
    while end and text[end - 1] in _CLOSE:
        start = by_end[end - 1]
        if start < 0:
            return "", []
        if inner := re.sub(r"^\s+|\s+$", "", text[start + 1 : end - 1]):
            held.append(inner)
        end = len(text[:start].rstrip())
    return text[:end].strip(), held[::-1]


@F.pandas_udf(StructType([StructField("head", StringType()), StructField("groups", ArrayType(StringType()))]))
def _parted(values: pd.Series) -> pd.DataFrame:
    rows = [trailing_groups(v or "") for v in values]
    return pd.DataFrame({"head": [r[0] for r in rows], "groups": [r[1] for r in rows]})


def place_parts(raw: Column, others: Column | None = None) -> Column:
    """struct(name, address, aliases, region, inferred) of a place string and other spellings (array).

    Brackets at the end are taken off.  Exactly one that looks like an address
    is the address; of two none is.  The rest are aliases, as are the string
    itself and the other spellings, but for those that look like addresses.
    """
    whole = F.trim(F.coalesce(raw, F.lit("")))
    parted = _parted(whole)
    split = (parted["head"] != "") & (F.size(parted["groups"]) > 0)
    groups = F.when(split, parted["groups"]).otherwise(F.array().cast("array<string>"))
    addresses = F.filter(groups, address_like)
    name = F.when(split, parted["head"]).otherwise(whole)
    address = F.when(F.size(addresses) == 1, F.get(addresses, F.lit(0)))
    spelled = F.transform(F.coalesce(others, F.array().cast("array<string>")) if others is not None else F.array().cast("array<string>"), lambda s: F.trim(F.coalesce(s, F.lit(""))))
    more = F.filter(spelled, lambda s: (s == whole) | ~address_like(s))
    inner = F.filter(groups, lambda g: ~address_like(g))
    extra = F.array_except(F.concat(F.array(whole), more), F.array(F.lit(""), name))
    aliases = F.concat(inner, F.array_except(extra, inner))
    return F.struct(name.alias("name"), address.alias("address"), aliases.alias("aliases"), region_of(address).alias("region"), (split & (name != whole)).alias("inferred"))
