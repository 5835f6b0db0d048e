"""Parsers of recorded pages and API payloads, from strings to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decoded, squeezed


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def board(pages: DataFrame, row: str) -> DataFrame:
    """page_id, nth, href, title for every match of ``row`` (two groups: address, title) in html."""
    found = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(row), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(row), F.lit(2)).alias("title"))).alias("nth", "r"))
    return found.select("page_id", "nth", "r.href", squeezed(decoded(F.col("r.title"))).alias("title"))


def json_ld(pages: DataFrame, kind: str = "Event") -> DataFrame:
    """page_id, name, start, end, place of every schema.org block of a kind; broken blocks give nothing."""
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    found = pages.select("page_id", F.explode(blocks).alias("block"))
    value = F.from_json("block", "`@type` string, name string, startDate string, endDate string, location struct<name:string>")
    return found.select("page_id", value.alias("v")).filter(F.col("v.`@type`") == kind).select("page_id", "v.name", F.col("v.startDate").alias("start"), F.col("v.endDate").alias("end"), F.col("v.location.name").alias("place"))


def sitemap(documents: DataFrame) -> DataFrame:
    """Every <loc> of sitemap documents (xml)."""
    return documents.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc")).select(decoded(F.col("loc")).alias("loc"))


def search_payload(raw: DataFrame) -> DataFrame:
    """Rows of a recorded search payload, either vendor's shape: title, link, snippet, place name, posted day."""
    doc = "array<struct<cafename:string,contents:string,datetime:string,title:string,url:string>>"
    item = "array<struct<title:string,link:string,description:string,cafename:string,bloggername:string,postdate:string>>"
    both = F.from_json("payload", f"documents {doc}, items {item}")
    rows = raw.select(both.alias("p"))
    clean = lambda c: squeezed(decoded(F.regexp_replace(c, r"(?i)</?b>", "")))
    first = rows.select(F.explode("p.documents").alias("d")).select(clean(F.col("d.title")).alias("title"), F.col("d.url").alias("link"), clean(F.col("d.contents")).alias("snippet"), F.col("d.cafename").alias("place"), F.to_date(F.left("d.datetime", F.lit(10))).alias("posted"))
    second = rows.select(F.explode("p.items").alias("d")).select(clean(F.col("d.title")).alias("title"), F.col("d.link").alias("link"), clean(F.col("d.description")).alias("snippet"), F.coalesce("d.cafename", "d.bloggername").alias("place"), F.to_date("d.postdate", "yyyyMMdd").alias("posted"))
    return first.unionAll(second)


def within_bounds(rows: DataFrame, hints: list[str], places: list[str]) -> DataFrame:
    """Rows whose link holds one of ``hints`` or whose place one of ``places``; no hints at all admit everything."""
    if not hints and not places:
        return rows
    keep = F.lit(False)
    for column, parts in (("link", hints), ("place", places)):
        for part in parts:
            keep = keep | F.coalesce(F.contains(F.lower(column), F.lit(part.lower())), F.lit(False))
    return rows.filter(keep)


def occurrences(rules: DataFrame, overrides: DataFrame, last: Column) -> DataFrame:
    """rule_id, day, title, start_min: weekly rules (rule_id, first_day, until, title, start_min) unrolled to ``last``.

    ``overrides`` (rule_id, day, cancelled, title, start_min) win field by field; cancelled days go.
    """
    days = rules.withColumn("day", F.explode(F.when(F.least("until", last) >= F.col("first_day"), F.sequence("first_day", F.least("until", last), F.expr("interval 7 days"))))).alias("r")
    joined = days.join(overrides.alias("o"), (F.col("r.rule_id") == F.col("o.rule_id")) & (F.col("r.day") == F.col("o.day")), "left")
    kept = joined.filter(~F.coalesce("o.cancelled", F.lit(False)))
    return kept.select("r.rule_id", "r.day", F.coalesce("o.title", "r.title").alias("title"), F.coalesce("o.start_min", "r.start_min").alias("start_min"))


def robots_allowed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """url, allowed: the longest matching rule (host, allow, path with * and $) decides, allowing on a tie; no match allows."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"([.+?^()\[\]{}|\\])", r"\\$1"), r"\*", ".*"), r"\$$", r"\$"))
    pattern = F.when(F.col("path").endswith("$"), pattern).otherwise(F.regexp_replace(pattern, r"\$", r"\\\$"))
    joined = urls.join(rules.withColumn("_pattern", pattern).filter("path <> ''"), "host", "left")
    hit = F.coalesce(F.expr("target rlike _pattern"), F.lit(False))
    best = F.max(F.when(hit, F.struct(F.length("path").alias("n"), F.col("allow").alias("allow"))))
    return joined.groupBy("host", "target").agg(F.coalesce(best.getField("allow"), F.lit(True)).alias("allowed"))


def csv_changes(incoming: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, action of an import: ERROR (no key, or twice in the file), CREATE, UPDATE or SKIP."""
    counted = incoming.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = counted.alias("n").join(stored.alias("s"), F.col(f"n.{key}") == F.col(f"s.{key}"), "left")
    action = F.when(F.col(f"n.{key}").isNull() | (F.col("n._n") > 1), "ERROR").when(F.col(f"s.{key}").isNull(), "CREATE").when(same, "SKIP").otherwise("UPDATE")
    return joined.select(F.col(f"n.{key}").alias(key), action.alias("action"))
