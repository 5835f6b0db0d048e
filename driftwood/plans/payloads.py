"""Typed values, labelled rows and scans by page over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses
from ..sources import payloads
from .registry import query, table


@query("""SELECT event_id AS document_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS second, value FROM events""")
def typed_documents(spark, sf_dir):
    """Events as typed documents, nested, and read back."""
    k = F.get_json_object("props", "$.k")
    typed = lambda kind, c: F.create_map(F.lit(kind), c)
    second = F.struct(F.struct(F.array(F.to_json(typed("stringValue", F.lit("first"))), F.to_json(typed("integerValue", (k.cast("long") + 1).cast("string")))).alias("values")).alias("arrayValue"))
    inner = F.struct(F.struct(F.struct(F.to_json(typed("integerValue", k)).alias("k"), F.to_json(second).alias("list")).alias("fields")).alias("mapValue"))
    fields = F.struct(F.to_json(typed("stringValue", F.col("event_type"))).alias("kind"), F.to_json(F.struct(F.col("value").alias("doubleValue"))).alias("value"), F.to_json(inner).alias("deep"))
    # values inside values were written as texts: their quotes go
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(fields), r'\\+"', '"'), r'"\{', "{"), r'\}"', "}")
    payload = F.concat(F.lit('{"documents":[{"name":"projects/p/events/'), F.col("event_id").cast("string"), F.lit('","fields":'), bare, F.lit("}]}"))
    found = payloads.typed_documents(table(spark, sf_dir, "events").select(F.col("event_id").alias("payload_id"), payload.alias("payload")))
    at = lambda path, kind: F.try_variant_get("fields", path, kind)
    return found.select(F.col("document_id").cast("long").alias("document_id"), at("$.deep.k", "long").alias("k"), at("$.kind", "string").alias("kind"), at("$.deep.list[1]", "long").alias("second"), at("$.value", "double").alias("value"))


@query(None)
def labelled_page_rows(spark, sf_dir):
    """A page's headline is the label of its paragraphs."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(payloads.labelled_rows(F.col("html"), "h1", "p", "article")).alias("nth", "r"))
    return rows.select("page_id", "nth", "r.label", "r.value")


_PAGE_DAYS = """d AS (SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS scan, page_id AS day, CASE WHEN contains(url, '?') THEN html END AS html, TRY_CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS stated FROM pages),
s AS (SELECT *, list_distinct(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS links, CASE WHEN html IS NULL THEN 'FETCH_FAILED' WHEN stated IS DISTINCT FROM day THEN 'PARSING_FAILED' WHEN len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) = 0 THEN 'VALID_EMPTY' ELSE 'PASS' END AS status FROM d)"""


@query(f"WITH {_PAGE_DAYS} SELECT scan, CASE WHEN count(*) FILTER (status LIKE '%FAILED') = 0 THEN 'PASS' WHEN count(*) FILTER (status LIKE '%FAILED') = count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS status, CAST(count(*) AS BIGINT) AS days, CAST(count(*) FILTER (status LIKE '%FAILED') AS BIGINT) AS failed, CAST(COALESCE(any_value(u.n), 0) AS BIGINT) AS links FROM s LEFT JOIN (SELECT scan AS of, count(DISTINCT link) AS n FROM (SELECT scan, unnest(links) AS link FROM s WHERE status = 'PASS') GROUP BY 1) u ON u.of = s.scan GROUP BY scan")
def page_scans(spark, sf_dir):
    """Pages of a language are the days of one scan; a page without a query in its address was not fetched."""
    pages = table(spark, sf_dir, "pages")
    html = F.when(F.contains("url", F.lit("?")), F.col("html"))
    asked = pages.select(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("scan"), F.col("page_id").alias("day"), html.alias("html"))
    stated = F.try_to_number(F.regexp_extract("html", r"track\((\d+)\)", 1), F.lit("999999999999")).cast("long")
    days = payloads.day_statuses(asked, stated, r'<li><a href="([^"]*)"')
    return payloads.scan_statuses(days).select("scan", "status", "days", "failed", F.size("links").cast("long").alias("links"))


@query("""WITH s AS (SELECT s_suppkey, s_name, 'Floor ' || s_suppkey % 9 AS floor, '서울 마포구 월드컵로 ' || s_suppkey AS address FROM supplier)
SELECT s_suppkey, s_name AS name, address, '서울' AS region, '두 (번째) 이름' || chr(10) || s_name || ' (두 (번째) 이름) (' || address || ' (' || floor || '))' || chr(10) || floor AS aliases FROM (SELECT s_suppkey, s_name, floor, address || ' (' || floor || ')' AS address FROM s) t""".replace("(' || address || ' (' || floor || '))'", "(' || address || ')'"))
def place_parts(spark, sf_dir):
    """Suppliers as places written with another name and an address in brackets, which has brackets of its own."""
    key = F.col("s_suppkey").cast("string")
    floor = F.concat(F.lit("Floor "), (F.col("s_suppkey") % 9).cast("string"))
    raw = F.concat("s_name", F.lit(" (두 (번째) 이름) (서울 마포구 월드컵로 "), key, F.lit(" ("), floor, F.lit("))"))
    parts = addresses.place_parts(raw, F.array(floor, F.lit("부산 어딘가"), F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", parts.alias("p")).select("s_suppkey", "p.name", "p.address", "p.region", F.array_join("p.aliases", "\n").alias("aliases"))
