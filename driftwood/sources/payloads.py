"""Nested payloads and pages that carry them: typed values, hydrated lists, labelled rows, day-by-day scans."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import decoded

# Wrappers of typed values whose content is the value as it stands.
PLAIN_WRAPPERS = ("stringValue", "doubleValue", "timestampValue", "geoPointValue", "referenceValue")
PASS, VALID_EMPTY, FETCH_FAILED, PARSING_FAILED, PARTIAL, FAILED = "PASS", "VALID_EMPTY", "FETCH_FAILED", "PARSING_FAILED", "PARTIAL", "FAILED"


def _whole(said):
    """A number written as text; what is none stays as it is."""
    return int(said) if isinstance(said, (int, str)) and str(said).strip().lstrip("+-").isdecimal() else said


#: How the content of each wrapper is read.
READERS: dict = dict.fromkeys(PLAIN_WRAPPERS, lambda said: said) | {
    "integerValue": _whole,
    "booleanValue": bool,
    "arrayValue": lambda said: [unwrapped(v) for v in (said or {}).get("values") or ()],
    "mapValue": lambda said: {k: unwrapped(v) for k, v in ((said or {}).get("fields") or {}).items()},
}


def unwrapped(value):
    """A typed value ({"integerValue": "3"}, {"mapValue": ...}) as a plain one, to any depth; unknown wrappers are null."""
    known = [kind for kind in value if kind in READERS] if isinstance(value, dict) else []
    return READERS[known[0]](value[known[0]]) if known else None


@F.pandas_udf(StringType())
def _plain_json(values: pd.Series) -> pd.Series:
    def plain(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(unwrapped({"mapValue": {"fields": json.loads(text)}}), ensure_ascii=False)
        except (ValueError, AttributeError, RecursionError):
            return None

    return values.map(plain)


def plain_fields(fields: Column) -> Column:
    """A document's typed fields (JSON text) as a VARIANT of plain values; null if they are no JSON object of typed values."""
    parsed = F.to_json(F.try_parse_json(fields))
    return F.try_parse_json(F.when(F.substr(F.ltrim(parsed), F.lit(1), F.lit(1)) == "{", _plain_json(parsed)))


def typed_documents(payloads: DataFrame) -> DataFrame:
    """payload_id, document_id, fields (VARIANT) for every document of list payloads (payload_id, payload); broken payloads give nothing."""
    listed = F.from_json("payload", "documents array<struct<name:string,fields:string>>")
    found = payloads.select("payload_id", F.explode(listed["documents"]).alias("d"))
    return found.select("payload_id", F.nullif(F.substring_index("d.name", "/", -1), F.lit("")).alias("document_id"), plain_fields(F.col("d.fields")).alias("fields"))


def hydrated(pages: DataFrame, script_id: str, path: list[str], list_of: str, item: str) -> DataFrame:
    """page_id, status, item (VARIANT): the rows of a list that a page carries in a script, one by one.

    ``path`` leads to an array of groups, each with an array ``list_of`` of
    rows of the shape ``item`` (a DDL type).  A page without the script, with
    broken JSON, or without a key of the path, is PARSING_FAILED, not empty; one
    whose list is there without rows is VALID_EMPTY.  Both come as one row
    without item.
    """
    block = F.nullif(F.regexp_extract("html", rf"""(?is)<script[^>]*id=["']{script_id}["'][^>]*>(.*?)</script>""", 1), F.lit(""))
    tree = pages.select("page_id", F.try_parse_json(block).alias("tree"))
    at = "$." + ".".join(path)
    groups = F.try_variant_get("tree", at, f"array<struct<{list_of}: array<{item}>>>")
    # a list that is there and null is an empty one; a key that is missing is a failure
    parent = F.try_variant_get("tree", "$." + ".".join(path[:-1]) if path[:-1] else "$", "map<string, variant>")
    there = F.coalesce(F.array_contains(F.map_keys(parent), path[-1]), F.lit(False))
    rows = F.flatten(F.transform(F.coalesce(groups, F.array().cast(f"array<struct<{list_of}: array<{item}>>>")), lambda g: F.coalesce(g[list_of], F.array().cast(f"array<{item}>"))))
    status = F.when(~there, PARSING_FAILED).when(F.size(rows) == 0, VALID_EMPTY).otherwise(PASS)
    return tree.select("page_id", status.alias("status"), F.explode_outer(F.when(there, rows)).alias("item"))


class _Rows(HTMLParser):
    """Pairs of a label element and the value elements after it, by a stack of the lists they stand in."""

    BREAKS = frozenset(("br", "p", "div", "li", "tr"))

    def __init__(self, label: str, value: str, container: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.container = (label, value), container
        # of each open list: the label last read, and what is being read
        self.levels: list[dict] = [{"label": None, "open": None, "text": []}]
        self.hidden, self.found = 0, []

    def _close(self, level: dict) -> None:
        if level["open"] is None:
            return
        lines = [" ".join(line.split()) for line in "".join(level["text"]).split("\n")]
        text = "\n".join(line for line in lines if line)
        if level["open"] == self.tags[0]:
            level["label"] = text
        else:
            self.found.append((level["label"], text))
        level["open"], level["text"] = None, []

    def handle_starttag(self, tag: str, attrs) -> None:
        level = self.levels[-1]
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.tags:
            self._close(level)
            level["open"] = tag
        elif tag == self.container:
            self.levels.append({"label": None, "open": None, "text": []})
        elif tag in self.BREAKS:
            self._add("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == self.levels[-1]["open"]:
            self._close(self.levels[-1])
        elif tag == self.container and len(self.levels) > 1:
            self._close(self.levels.pop())
        elif tag in self.BREAKS:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._add(data)

    def _add(self, text: str) -> None:
        # an inner list's text is part of what is open around it
        for level in self.levels:
            if level["open"] is not None:
                level["text"].append(text)

    def rows(self, html: str) -> list[tuple[str | None, str]]:
        self.feed(html)
        self.close()
        while self.levels:
            self._close(self.levels.pop())
        return self.found


def labelled_rows(html: Column, label: str = "dt", value: str = "dd", container: str = "dl") -> Column:
    """array<struct<label, value>> of a page: each value element with the label before it in its list, markup gone, lines kept; unclosed elements end where the next begins.

    Pages come to Python a hundred at a time: an Arrow batch would hold ten thousand whole ones.
    """
    kind = ArrayType(StructType([StructField("label", StringType()), StructField("value", StringType())]))

    @F.udf(kind, useArrow=False)
    def read(page: str | None) -> list[tuple[str | None, str]]:
        return [] if page is None else _Rows(label, value, container).rows(page)

    return read(html)


def row_of(rows: Column, label: str) -> Column:
    """The value of the first row with a label, case aside; null if there is none or it is empty."""
    hits = F.filter(rows, lambda r: F.upper(F.trim(r.label)) == label.upper())
    return F.nullif(F.get(hits, F.lit(0))["value"], F.lit(""))


def day_statuses(asked: DataFrame, stated: Column, link: str) -> DataFrame:
    """scan, day, status, links for each day asked of a paged source (scan, day, html; html null: not fetched).

    ``stated`` is the day that a page says it is of.  A day whose page says
    nothing, or another day, was not read, whatever it lists; one read without
    a link (``link``, one group) is VALID_EMPTY.
    """
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(link), F.lit(1)), decoded))
    status = F.when(F.col("html").isNull(), FETCH_FAILED).when(~F.coalesce(stated == F.col("day"), F.lit(False)), PARSING_FAILED).when(F.size(links) == 0, VALID_EMPTY).otherwise(PASS)
    return asked.select("scan", "day", status.alias("status"), F.when(status == PASS, links).otherwise(F.array().cast("array<string>")).alias("links"))


def scan_statuses(days: DataFrame) -> DataFrame:
    """scan, status, days, failed, links of ``day_statuses``: PASS if every day was read, FAILED if none was, PARTIAL else; links once each, by the first day that lists them."""
    failed = F.count_if(F.col("status").isin(FETCH_FAILED, PARSING_FAILED))
    counted = days.groupBy("scan").agg(F.count("*").alias("days"), failed.alias("failed"))
    first = days.select("scan", "day", F.posexplode("links").alias("nth", "link")).groupBy("scan", "link").agg(F.min(F.struct("day", "nth")).alias("first"))
    linked = first.groupBy("scan").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "link"))), lambda x: x.link).alias("links"))
    status = F.when(F.col("failed") == 0, PASS).when(F.col("failed") == F.col("days"), FAILED).otherwise(PARTIAL)
    return counted.join(linked, "scan", "left").select("scan", status.alias("status"), "days", "failed", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
