"""Candidates normalised to events over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalizing
from .registry import query, table
from .shapes import EVENTS_SQL, events

_TYPES = {"MACHINERY": "salsa", "BUILDING": "tango"}
_NAMED = "CASE event_id % 4 WHEN 0 THEN ['kizomba'] WHEN 1 THEN ['bachata', 'bachata'] WHEN 2 THEN ['swing', 'zouk'] ELSE [] END"
_CLEAN = "regexp_replace(lower('The ' || venue || ' 12.5 Friday! No ' || genre), '[0-9]{1,4}([./-][0-9]{1,2})*|(mon|tues|wednes|thurs|fri|satur|sun)day|[^a-z0-9 ]', '', 'g')"
_NORMAL = f"""x AS (SELECT event_id, event_date, CASE WHEN event_id % 3 <> 0 THEN source_id END AS venue_id, CASE genre WHEN 'MACHINERY' THEN 'salsa' WHEN 'BUILDING' THEN 'tango' ELSE COALESCE(CASE WHEN len(list_distinct({_NAMED})) = 1 THEN ({_NAMED})[1] END, CASE WHEN source_id % 2 = 0 THEN 'mixed' END) END AS genre,
COALESCE(CASE WHEN event_id % 3 <> 0 THEN region END, CASE WHEN tier = 'OFFICIAL' THEN 'BOARD ' || region END, CASE WHEN event_id % 2 = 0 THEN venue END) AS region, CASE WHEN start_min IS NULL OR tier = 'PRIMARY' THEN 0 ELSE COALESCE(CASE WHEN start_min > 1200 THEN 1 END, 0) END AS end_day_offset,
start_min, canonical_id, CASE WHEN canonical_id IS NOT NULL OR status = 'POSSIBLE' THEN 'HIDDEN' ELSE 'LISTED' END AS listing, {_CLEAN} AS core FROM ev)"""


def _normal(spark, sf_dir):
    k = F.col("event_id")
    text = lambda *values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    named = F.when(k % 4 == 0, text("kizomba")).when(k % 4 == 1, text("bachata", "bachata")).when(k % 4 == 2, text("swing", "zouk")).otherwise(text())
    venue, structured = F.when(k % 3 != 0, F.col("source_id")), F.when(k % 2 == 0, F.array("venue", "venue")).otherwise(F.array("venue", F.concat(F.col("venue"), F.lit("?"))))
    name = F.concat(F.lit("The "), F.col("venue"), F.lit(" 12.5 Friday! No "), F.col("genre"))
    return events(spark, sf_dir).select(
        "event_id", "event_date", venue.alias("venue_id"), normalizing.genre(F.col("genre"), named, F.when(F.col("source_id") % 2 == 0, "mixed"), _TYPES).alias("genre"),
        normalizing.region(F.when(k % 3 != 0, F.col("region")), F.when(F.col("tier") == "OFFICIAL", F.concat(F.lit("BOARD "), F.col("region"))), structured).alias("region"),
        normalizing.end_day_offset(F.when(F.col("start_min") > 1200, 1), F.col("start_min"), F.col("tier") == "PRIMARY").alias("end_day_offset"), "start_min", "canonical_id",
        normalizing.listing(F.col("canonical_id"), F.when(F.col("status") == "POSSIBLE", "rejected")).alias("listing"),
        normalizing.identity_key(F.col("event_date"), venue, F.col("start_min")).alias("identity_key"), normalizing.series_key(venue, F.col("event_date"), name).alias("series_key"),
    )


@query(f"""WITH {EVENTS_SQL}, {_NORMAL} SELECT event_id, genre, region, CAST(end_day_offset AS INTEGER) AS end_day_offset, listing, concat_ws('|', CAST(event_date AS VARCHAR), COALESCE(CAST(venue_id AS VARCHAR), ''), COALESCE(CAST(start_min AS VARCHAR), '')) AS identity_key,
concat_ws('|', COALESCE(CAST(venue_id AS VARCHAR), ''), CAST(isodow(event_date) - 1 AS VARCHAR), trim(regexp_replace(core, ' +', ' ', 'g'))) AS series_key FROM x""")
def normalized_events(spark, sf_dir):
    return _normal(spark, sf_dir).select("event_id", "genre", "region", "end_day_offset", "listing", "identity_key", "series_key")


@query(f"""WITH {EVENTS_SQL}, {_NORMAL} SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(venue_id) AS BIGINT) AS venue, CAST(count(region) AS BIGINT) AS region, CAST(count(genre) AS BIGINT) AS genre, CAST(count(start_min) AS BIGINT) AS started, CAST(count(canonical_id) AS BIGINT) AS folded, CAST(count(*) FILTER (WHERE listing = 'HIDDEN') AS BIGINT) AS hidden FROM x""")
def normalization_metrics(spark, sf_dir):
    return normalizing.metrics(_normal(spark, sf_dir))


@query("""WITH i AS (SELECT 'u' || (l_partkey % 1500) AS url, l_orderkey * 10 + l_linenumber AS item_id, CASE WHEN l_returnflag = 'N' THEN 'live' ELSE 'file' END AS mode FROM lineitem), n AS (SELECT url, max(item_id) AS item_id, arg_max(mode, item_id) AS mode FROM i GROUP BY 1)
SELECT o_orderkey AS event_id, item_id, CASE WHEN mode = 'live' THEN 'LIVE' WHEN mode IS NOT NULL THEN 'SNAPSHOT' END AS provenance FROM orders LEFT JOIN n ON url = 'u' || (o_custkey % 2000)""")
def event_provenance(spark, sf_dir):
    url = lambda c, n: F.concat(F.lit("u"), (F.col(c) % n).cast("string"))
    items = table(spark, sf_dir, "lineitem").select(url("l_partkey", 1500).alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.when(F.col("l_returnflag") == "N", "live").otherwise("file").alias("mode"))
    return normalizing.provenance(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), url("o_custkey", 2000).alias("url")), items)


@query("""WITH t AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '-') || '!' END AS text, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, min(text) AS text, CAST(count(*) AS BIGINT) AS n, max(day) AS last_day FROM t GROUP BY 1""")
def unresolved_places(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("!")))
    return normalizing.unresolved(lines.select(text.alias("text"), F.to_date("l_shipdate").alias("day")))
