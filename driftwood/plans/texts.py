"""Text, page and address operators over documents and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import tagging
from ..operators.graphs import stored
from ..sources import pages as page_sources
from .registry import query, table


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS body FROM pages""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("body"))


@query(None)
def page_article(spark, sf_dir):
    found = text.article(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", found.alias("a"))
    return pages.select("page_id", "a.method", F.length("a.text").alias("chars"), text.is_menu(F.col("a.text")).alias("menu"), F.sha2("a.text", 256).alias("content_hash"))


@query("""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')), '') AS title FROM pages""")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical, lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) AS host FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.host(F.col("url")).alias("host"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '0[0-9]{1,2}[-\\s.]?[0-9]{3,4}[-\\s.]?[0-9]{4}', '[PHONE]', 'g'), '\\b[0-9]{10,16}\\b', '[ACCOUNT]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[EMAIL]', 'g')) AS clean_md5 FROM documents""")
def redacted_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted(F.col("text"))).alias("clean_md5"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '0[0-9]{1,2}[-\\s.]?[0-9]{3,4}[-\\s.]?[0-9]{4}')) + len(regexp_extract_all(p, '\\b[0-9]{10,16}\\b')) + len(regexp_extract_all(a, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS BIGINT) AS n
FROM (SELECT *, regexp_replace(p, '\\b[0-9]{10,16}\\b', '[ACCOUNT]', 'g') AS a FROM (SELECT *, regexp_replace(text, '0[0-9]{1,2}[-\\s.]?[0-9]{3,4}[-\\s.]?[0-9]{4}', '[PHONE]', 'g') AS p FROM documents))""")
def redaction_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redactions(F.col("text")).cast("long").alias("n"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')))) AS canonical_id FROM documents")
def exact_duplicates(spark, sf_dir):
    # digests are stored, so that the texts are read and squeezed once for both sides of the join
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squeezed(F.lower("text"))).alias("h")), "digests")
    # the least id of each text is found before the join, so copies meet no window
    first = docs.groupBy("h").agg(F.min("doc_id").alias("canonical_id"))
    return docs.join(first, "h").select("doc_id", "canonical_id")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, CAST(len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS BIGINT) AS distinct_links FROM pages")
def page_links(spark, sf_dir):
    links = page_sources.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("distinct_links"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def board_rows(spark, sf_dir):
    return page_sources.board(table(spark, sf_dir, "pages"), r'<li><a href="([^"]*)">([^<]*)</a>').select("page_id", "href")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])mit license([^a-z0-9]|$)') THEN 'MIT' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])apache license([^a-z0-9]|$)') THEN 'APACHE' WHEN length(text) < 200 THEN 'SHORT' ELSE 'OTHER' END AS label FROM documents")
def ordered_classification(spark, sf_dir):
    body = F.col("text")
    label = F.when(text.occurs("mit license", body), "MIT").when(text.occurs("apache license", body), "APACHE").when(F.length(body) < 200, "SHORT").otherwise("OTHER")
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


def _terms(spark, sf_dir):
    """Words and phrases that benchmark items open with, of the language they seem to be in."""
    items = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    phrases = F.posexplode(F.array(words[0], F.concat_ws(" ", words[0], words[1]), F.concat_ws(" ", words[1], words[2]), words[2]))
    kinds = F.array(F.array(F.lit("EVENING")), F.array(F.lit("PRACTICE"), F.lit("EVENING")), F.array(F.lit("SOCIAL")), F.array(F.lit("WALK")))
    lang = F.when(F.col("text").rlike(r"\b(the|and)\b"), "en").when(F.col("text").rlike(r"\b(le|les|des)\b"), "fr").when(F.col("text").rlike(r"\b(der|die|und)\b"), "de")
    opened = items.select("item_id", "text", lang.alias("genre"), phrases.alias("k", "term"))
    return opened.select((F.col("item_id") * 4 + F.col("k")).alias("term_id"), "term", F.element_at(kinds, F.col("k") + 1).alias("formats"), (F.length("text") % 7 > 0).alias("enabled"), "genre")


def _tagged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("genre"))
    return tagging.tagged(docs, _terms(spark, sf_dir), tagging.Kinds().order)


@query(None)
def dictionary_tags(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _tagged(spark, sf_dir).select(F.col("key").alias("doc_id"), "term", F.array_join("terms", ",").alias("tags"), joined("formats"), joined("term_ids"))


@query(None)
def event_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    types = F.element_at(F.array(*map(F.lit, ("EVENING", "PRACTICE", "PARTY", "FESTIVAL", "LECTURE", " "))), (F.col("n_chars") % 6 + 1).cast("int"))
    stored = F.when(F.col("n_chars") % 5 == 0, F.array(F.lit("SOCIAL"), F.lit("EVENING")))
    events = docs.select(F.col("doc_id").alias("key"), types.alias("event_type"), stored.alias("stored")).join(_tagged(spark, sf_dir), "key")
    found = tagging.kinds(events, tagging.Kinds())
    return found.select(F.col("key").alias("doc_id"), "display", F.array_join("kind_formats", ",").alias("formats"), "certainty", "uncertain", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) - ((isodow(last_day(CAST(o_orderdate AS DATE))) + 1) % 7)::INTEGER AS last_saturday,
date_trunc('month', o_orderdate)::DATE + ((13 - isodow(date_trunc('month', o_orderdate)::DATE)) % 7)::INTEGER + 7 AS second_saturday FROM orders""")
def nth_weekdays(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.nth_weekday(day, "SAT", -1).alias("last_saturday"), dates.nth_weekday(day, "SAT", 2).alias("second_saturday"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS published, CAST(o_orderkey % 12 + 1 AS INTEGER) AS m, CAST(o_orderkey % 31 + 1 AS INTEGER) AS d FROM orders), c AS (SELECT o_orderkey, published, k, try_cast(format('{:04d}-{:02d}-{:02d}', year(published) + k, m, d) AS DATE) AS day FROM o, (VALUES (-1), (0), (1)) t(k)),
b AS (SELECT o_orderkey, arg_min(day, (abs(date_diff('day', published, day)), day)) AS best, min(abs(date_diff('day', published, day))) AS far FROM c WHERE day IS NOT NULL GROUP BY 1) SELECT o.o_orderkey, CASE WHEN far <= 200 THEN best END AS event_day FROM o LEFT JOIN b USING (o_orderkey)""")
def yearless_dates(spark, sf_dir):
    month, day = (F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_orderkey") % 31 + 1).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.nearest_year(month, day, F.to_date("o_orderdate")).alias("event_day"))


@query("SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS seoul_day FROM events")
def local_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.local_day(F.col("ts")).alias("seoul_day"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+@\\t\\r-]') THEN '''' || v ELSE v END AS cell FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '=' || c_name WHEN c_custkey % 3 = 1 THEN '-' || c_mktsegment ELSE c_name END AS v FROM customer)")
def formula_guard(spark, sf_dir):
    k = F.col("c_custkey") % 3
    value = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.concat(F.lit("-"), "c_mktsegment")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.csv_safe(value).alias("cell"))


TODAY = dt.date(2024, 1, 31)


@query("""SELECT user_id, CASE WHEN max(CAST(ts AS DATE)) >= DATE '2024-01-30' THEN 'ACTIVE' WHEN max(CAST(ts AS DATE)) >= DATE '2024-01-25' THEN 'STALE' ELSE 'INACTIVE' END AS activity FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def activity_grade(spark, sf_dir):
    last = F.max(F.to_date("ts"))
    grade = F.when(last >= F.lit("2024-01-30").cast("date"), "ACTIVE").when(last >= F.lit("2024-01-25").cast("date"), "STALE").otherwise("INACTIVE")
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(grade.alias("activity"))
