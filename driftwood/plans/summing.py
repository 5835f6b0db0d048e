"""Summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries
from .registry import query, table
from .shapes import EVENTS_SQL, events

_TODAY = "1997-03-01"


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT region, genre, count(*) FILTER (WHERE date_diff('day', DATE '{_TODAY}', event_date) BETWEEN 0 AND 7) AS d7, count(*) FILTER (WHERE date_diff('day', DATE '{_TODAY}', event_date) BETWEEN 0 AND 14) AS d14, count(*) FILTER (WHERE date_diff('day', DATE '{_TODAY}', event_date) BETWEEN 0 AND 30) AS d30 FROM ev GROUP BY 1, 2)
SELECT r.region, g.genre, CAST(COALESCE(d7, 0) AS BIGINT) AS d7, CAST(COALESCE(d14, 0) AS BIGINT) AS d14, CAST(COALESCE(d30, 0) AS BIGINT) AS d30 FROM (SELECT DISTINCT region FROM ev) r CROSS JOIN (SELECT DISTINCT genre FROM ev) g LEFT JOIN c ON c.region = r.region AND c.genre = g.genre""")
def genre_region_windows(spark, sf_dir):
    return summaries.windowed_grid(events(spark, sf_dir), "region", "genre", "event_date", F.lit(_TODAY).cast("date"), {"d7": 7, "d14": 14, "d30": 30})


_SOURCES = f"""a AS (SELECT l_suppkey AS source_id, count(*) AS items, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 20) AS fetched FROM lineitem GROUP BY 1),
b AS (SELECT source_id % 80 AS source_id, count(*) AS events, count(*) FILTER (WHERE canonical_id IS NULL) AS listed, count(*) FILTER (WHERE event_date >= DATE '{_TODAY}') AS upcoming FROM ev GROUP BY 1)"""


def _source_rows(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 20), "FETCHED_FULL").otherwise("FETCH_FAILED").alias("status"))
    held = events(spark, sf_dir).select((F.col("source_id") % 80).alias("source_id"), F.when(F.col("canonical_id").isNull(), "LISTED").otherwise("HIDDEN").alias("listing"), "event_date")
    return items, held


@query(f"WITH {EVENTS_SQL}, {_SOURCES} SELECT COALESCE(a.source_id, b.source_id) AS source_id, CAST(COALESCE(items, 0) AS BIGINT) AS items, CAST(COALESCE(fetched, 0) AS BIGINT) AS fetched, CAST(COALESCE(events, 0) AS BIGINT) AS events, CAST(COALESCE(listed, 0) AS BIGINT) AS listed FROM a FULL JOIN b ON a.source_id = b.source_id")
def source_breakdown(spark, sf_dir):
    return summaries.breakdown(*_source_rows(spark, sf_dir), "source_id")


@query(f"""WITH {EVENTS_SQL}, {_SOURCES}, j AS (SELECT COALESCE(a.source_id, b.source_id) AS source_id, COALESCE(items, 0) AS items, COALESCE(fetched, 0) AS fetched, COALESCE(events, 0) AS events, COALESCE(upcoming, 0) AS upcoming FROM a FULL JOIN b ON a.source_id = b.source_id)
SELECT source_id, CASE WHEN items = 0 THEN 'NOTHING_FOUND' WHEN fetched = 0 THEN 'NOTHING_FETCHED' WHEN fetched < items * 0.5 THEN 'MOSTLY_BLOCKED' WHEN events = 0 THEN 'NOTHING_EXTRACTED' WHEN upcoming = 0 THEN 'ONLY_PAST' ELSE 'YIELDING' END AS diagnosis FROM j""")
def yield_diagnosis(spark, sf_dir):
    items, held = _source_rows(spark, sf_dir)
    coming = held.groupBy("source_id").agg(F.count_if(F.col("event_date") >= F.lit(_TODAY).cast("date")).alias("upcoming"))
    joined = summaries.breakdown(items, held, "source_id").join(coming, "source_id", "left").fillna(0, ["upcoming"])
    return joined.select("source_id", summaries.diagnosis(F.col("items"), F.col("fetched"), F.col("events"), F.col("upcoming")).alias("diagnosis"))


@query("""WITH g AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_day, count(*) AS items, count(DISTINCT event_type) AS kinds, bool_or(value > 280) AS critical FROM events WHERE value > 120 GROUP BY 1)
SELECT user_id, first_day, CAST(items AS BIGINT) AS items, CAST(kinds AS BIGINT) AS kinds, CASE WHEN critical AND kinds >= 2 THEN 'CRITICAL' WHEN critical OR kinds >= 3 THEN 'HIGH' WHEN items >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g""")
def evidence_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value > 120").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), (F.col("value") > 280).alias("critical"))
    return summaries.evidence_clusters(rows, "user_id", "day")


@query("""SELECT event_type AS action, user_id % 5 AS actor, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-20') AS BIGINT) AS today, round(avg((event_id % 500) / 10.0), 6) AS mean_hours FROM events GROUP BY 1, 2""")
def review_metrics(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    queued = F.timestamp_micros(F.unix_micros(at) - F.col("event_id") % 500 * 360_000_000)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), (F.col("user_id") % 5).alias("actor"), at.alias("at"), queued.alias("queued_at"))
    return summaries.review_metrics(rows, ["action", "actor"], F.lit("2024-01-20").cast("date"))


@query("""WITH h AS (SELECT p_brand AS name, min(p_type) AS field, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) AS severe FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), t AS (SELECT *, n + 2 * severe AS weight FROM h ORDER BY n + 2 * severe DESC, name LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY weight DESC, name) AS BIGINT) AS rank, name, 'IMPROVE_' || upper(field) AS epic, CAST(weight AS BIGINT) AS weight, CASE WHEN severe * 4 > n THEN 'P0' WHEN weight >= 1000 THEN 'P1' ELSE 'P2' END AS urgency FROM t""")
def backlog_recommendation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    spots = lines.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("field"), F.count("*").alias("n"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).alias("severe"))
    return summaries.backlog(spots, 10)


@query("""WITH r AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'ROUTED' ELSE 'NONE' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT CAST(count(*) AS BIGINT) AS triggers, CAST(count(*) FILTER (WHERE status = 'ROUTED') AS BIGINT) AS routed, round(count(*) FILTER (WHERE status = 'ROUTED') / count(*), 4) AS rate FROM r WHERE k = 1""")
def continuity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("view", "click"), "ROUTED").otherwise("NONE").alias("status"))
    return summaries.latest_routes(rows, "user_id", ["ts", "event_id"])


@query("""WITH p AS (SELECT c_custkey AS source, alternative, rel FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0) JOIN (SELECT c_custkey AS alternative, c_nationkey, c_acctbal AS rel FROM customer WHERE c_acctbal > 5000) USING (c_nationkey) WHERE c_custkey <> alternative),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rel DESC, alternative) AS nth FROM p) SELECT source, alternative, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 2""")
def alternative_routes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    good = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("alternative"), "c_nationkey", F.col("c_acctbal").alias("reliability"))
    return summaries.best_routes(c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("source"), "c_nationkey"), good, "c_nationkey")


@query("""WITH w AS (SELECT l_suppkey, word, min(l_orderkey) AS first_at FROM (SELECT l_suppkey, l_orderkey, unnest(string_split(p_name, ' ')) AS word FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_at, word) AS k FROM w)
SELECT l_suppkey, string_agg(word, ',' ORDER BY k) AS keywords FROM r WHERE k <= 6 GROUP BY 1""")
def query_profiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    words = lines.select("l_suppkey", "l_orderkey", F.explode(F.split("p_name", " ")).alias("word"))
    return summaries.keyword_profile(words, "l_suppkey", "l_orderkey", 6)


@query("""SELECT p_partkey AS text_id, s_suppkey AS place, CASE WHEN s_nationkey % 5 = p_size % 5 OR s_suppkey % 3 = p_partkey % 3 THEN TRUE ELSE FALSE END AS agreed
FROM part JOIN supplier ON contains(regexp_replace(lower('at ' || p_name || ' hall ' || (p_partkey % 120)), '[^a-z0-9]', '', 'g'), 'hall' || (s_suppkey % 100))""")
def place_mentions(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("at "), F.col("p_name"), F.lit(" hall "), (F.col("p_partkey") % 120).cast("string")).alias("text"), (F.col("p_size") % 5).alias("region"), (F.col("p_partkey") % 3).alias("genre"))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.concat(F.lit("Hall "), (F.col("s_suppkey") % 100).cast("string")).alias("name"), (F.col("s_nationkey") % 5).alias("p_region"), (F.col("s_suppkey") % 3).alias("p_genre"))
    return summaries.mentions(texts, places)
