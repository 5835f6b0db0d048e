"""Sources, supply, masters, labels: reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import clamp
from ..functions.text import folded_key, similarity
from ..operators import resolution, streaks, supply
from .registry import query, table
from .shapes import EVENTS_SQL, events


@query("""WITH p AS (SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS passed, ts, event_type FROM events),
r AS (SELECT user_id, max(ts) AS last_run, max(ts) FILTER (WHERE event_type <> 'error') AS last_ok, count(*) FILTER (WHERE passed = 0) AS streak FROM p GROUP BY 1), i AS (SELECT o_custkey, count(*) AS items FROM orders GROUP BY 1)
SELECT c_custkey AS source_id, last_run, last_ok, CAST(COALESCE(streak, 0) AS BIGINT) AS streak, CAST(COALESCE(items, 0) AS BIGINT) AS items, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(last_ok))) / 3600) AS BIGINT) AS fresh_hours FROM customer LEFT JOIN r ON user_id = c_custkey LEFT JOIN i ON o_custkey = c_custkey""")
def source_freshness(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("run_id"), (F.col("event_type") != "error").alias("ok"))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"))
    return supply.freshness(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id")), runs, items, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT n_name AS place, count(event_id) FILTER (WHERE event_date >= DATE '1998-11-20') AS upcoming, count(event_id) FILTER (WHERE genre = 'BUILDING') AS served FROM nation LEFT JOIN ev ON venue = n_name GROUP BY 1), s AS (SELECT n_name AS place, count(s_suppkey) AS sources, COALESCE(bool_or(s_acctbal < 0), FALSE) AS failing FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT place, CASE WHEN failing AND served > 0 THEN 'COLLECTOR_FAILING' WHEN sources = 0 THEN 'NO_SOURCE' WHEN served % 2 = 1 THEN 'UNATTRIBUTED' ELSE 'NONE_LISTED' END AS reason FROM g JOIN s USING (place) WHERE upcoming % 4 = 0""")
def zero_supply(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), "n_nationkey")
    e = events(spark, sf_dir).groupBy(F.col("venue").alias("place")).agg(F.count_if(F.col("event_date") >= F.lit("1998-11-20").cast("date")).alias("late"), F.count_if(F.col("genre") == "BUILDING").alias("served"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("sources"), F.bool_or(F.col("s_acctbal") < 0).alias("failing"))
    joined = nations.join(e, "place", "left").join(s, "n_nationkey", "left").fillna({"late": 0, "served": 0, "sources": 0, "failing": False})
    return supply.zero_reasons(joined.select("place", (F.col("late") % 4).alias("upcoming"), "served", "sources", "failing", (F.col("served") % 2).alias("unattributed")))


@query("""WITH o AS (SELECT o_custkey, count(*) AS items, count(*) FILTER (WHERE o_orderstatus = 'P') AS blocked, count(*) FILTER (WHERE o_totalprice > 250000) AS events FROM orders GROUP BY 1), s AS (SELECT c_custkey AS source_id, c_acctbal > 0 AS enabled, COALESCE(items, 0) AS items, COALESCE(blocked, 0) AS blocked, COALESCE(events, 0) AS events, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1 AS alternatives FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT source_id, CASE WHEN NOT enabled OR items = 0 THEN 'MONITOR' WHEN blocked = items THEN CASE WHEN alternatives > 0 THEN 'REPLACE' ELSE 'KEEP' END WHEN events = 0 THEN 'MONITOR' ELSE 'ACTIVE' END AS advice FROM s""")
def source_advice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("items"), F.count_if(F.col("o_orderstatus") == "P").alias("blocked"), F.count_if(F.col("o_totalprice") > 250000).alias("events"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("genre"))
    return supply.recommended(supply.with_alternatives(sources, "genre").join(o, "source_id", "left").fillna(0, ["items", "blocked", "events"]))


@query("SELECT k AS c_custkey, min(v) AS nearest FROM (SELECT o_custkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal + 1000 FROM customer) GROUP BY 1")
def relevance_union(spark, sf_dir):
    parts = [table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("nearest")), table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("nearest"))]
    return supply.least_of_union(parts, "c_custkey", "nearest")


@query("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT t.event_type, d.day, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM d CROSS JOIN t LEFT JOIN c ON c.event_type = t.event_type AND c.day = d.day""")
def usage_daily(spark, sf_dir):
    return _usage_daily(spark, sf_dir, table(spark, sf_dir, "events"))


def _usage_daily(spark, sf_dir, counted):
    spine = table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day"))
    counts = counted.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["event_type", "day"], "left").fillna(0, ["n"])


@query("""SELECT n_name, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS customers, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS suppliers, CAST((SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS BIGINT) AS orders FROM nation""")
def master_usage(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    a = customers.join(per_customer, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum(F.coalesce("k", F.lit(0))).alias("orders"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, sf_dir, "nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").fillna(0, ["customers", "orders", "suppliers"]).select("n_name", "customers", "suppliers", "orders")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST('0x' || left(md5(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)), 12) AS BIGINT)) AS VARCHAR) AS digest FROM customer")
def master_digest(spark, sf_dir):
    return supply.revision_digest(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_mktsegment")


@query("""WITH w AS (SELECT event_type, avg(CASE WHEN CAST(round(value * 100) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS lean, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(greatest(0.75, least(1.25, 1.0 + lean * least(n, 5) * 0.05)), 6) AS weight FROM w""")
def adaptive_weights(spark, sf_dir):
    lean = F.avg(F.when(F.round(F.col("value") * 100).cast("long") % 2 == 0, 1.0).otherwise(-1.0))
    w = table(spark, sf_dir, "events").groupBy("event_type").agg(lean.alias("lean"), F.count("*").alias("n"))
    return w.select("event_type", F.round(clamp(1.0 + F.col("lean") * F.least("n", F.lit(5)) * 0.05, 0.75, 1.25), 6).alias("weight"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_date > DATE '1998-06-03' THEN 'UPCOMING' WHEN end_date IS NULL AND genre = 'MACHINERY' AND event_date < DATE '1998-06-03' THEN 'UNKNOWN' WHEN COALESCE(end_date, event_date) >= DATE '1998-06-03' THEN 'ONGOING' ELSE 'PAST' END AS timing FROM ev")
def event_timing(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", labels.timing(F.col("event_date"), F.col("end_date"), F.col("genre") == "MACHINERY", F.lit("1998-06-03").cast("date")).alias("timing"))


@query("SELECT a.l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE abs((a.l_partkey % 24) - (b.l_partkey % 24)) * 60 = 720 GROUP BY 1")
def half_day_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 24 * 60).alias("m"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.filter(labels.half_day_apart(F.col("a.m"), F.col("b.m"))).groupBy("a.l_orderkey").agg(F.count("*").alias("n"))


_ANSWERS = (("NAVER_ID is not set", 401), ("unauthorised", 401), ("no access", 403), ("slow down", 429), ("bad gateway", 502), ("Network error: reset", None), ("read Timed Out", None), ("Expecting value: JSON line 1", 200), ("gone", 404), (None, 500), (None, None))
_ANSWERS_SQL = "r(k, message, status) AS (VALUES " + ", ".join(f"({k}, {m!r}, {s})".replace("None", "NULL") for k, (m, s) in enumerate(_ANSWERS)) + ")"


@query(f"""WITH {_ANSWERS_SQL}, k AS (SELECT k, CASE WHEN lower(message) LIKE '%not set%' THEN 'CREDENTIALS_MISSING' WHEN status = 401 THEN 'AUTH_FAILED' WHEN status = 403 THEN 'ACCESS_DENIED' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status // 100 = 5 OR lower(message) LIKE '%network error%' OR lower(message) LIKE '%timed out%' OR lower(message) LIKE '%timeout%' THEN 'NETWORK' WHEN lower(message) LIKE '%json%' THEN 'BAD_RESPONSE' ELSE 'UNKNOWN' END AS kind FROM r)
SELECT event_id, kind, kind IN ('NETWORK', 'RATE_LIMITED') AS retryable FROM events JOIN k ON k.k = (event_id * 7 + user_id) % {len(_ANSWERS)}""")
def error_kinds(spark, sf_dir):
    k = ((F.col("event_id") * 7 + F.col("user_id")) % len(_ANSWERS)).cast("int")
    said = F.array(*[F.struct(F.lit(m).cast("string").alias("message"), F.lit(s).cast("int").alias("status")) for m, s in _ANSWERS])
    rows = table(spark, sf_dir, "events").select("event_id", F.get(said, k).alias("r"))
    return rows.select("event_id", labels.error_kind(F.col("r.status"), F.col("r.message")).alias("e")).select("event_id", "e.kind", "e.retryable")


@query("SELECT page_id, 'host:' || regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)), '^www\\.', '') AS identity FROM pages")
def community_identities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", labels.community_identity(F.col("url")).alias("identity"))


_IMAGES_SQL = """SELECT p_partkey, lower(concat('https://img.example/', CASE p_size % 5 WHEN 0 THEN 'site-Logo.png' WHEN 1 THEN 'milonga-poster.jpg' WHEN 2 THEN 'hall.jpg' WHEN 3 THEN 'profile.png' ELSE 'x.png' END)) AS url,
lower(concat(p_name, CASE WHEN p_partkey % 7 = 0 THEN ' party schedule' WHEN p_partkey % 7 = 1 THEN ' Our LOGO here' WHEN p_partkey % 7 = 2 THEN ' the logotype' ELSE '' END)) AS beside, CASE WHEN p_size > 10 THEN p_size * 20 END AS w, p_size * 20 + p_partkey % 60 AS h FROM part"""


@query(f"""WITH i AS ({_IMAGES_SQL}), f AS (SELECT *, regexp_matches(url || ' ' || beside, 'poster|flyer|schedule|milonga|party|festival|workshop|포스터|일정') AS event, regexp_matches(url || ' ' || beside, 'venue|interior|hall|studio|map|공간|내부') AS venue FROM i),
k AS (SELECT *, CASE WHEN url LIKE '%logo%' OR regexp_matches(beside, '\\blogo\\b') THEN 1 WHEN event AND COALESCE(w <= 256 AND h <= 256 AND abs(w - h) <= 32, FALSE) THEN 2 WHEN event THEN 3 WHEN venue THEN 4 WHEN regexp_matches(url, 'icon|brand|profile|favicon') AND COALESCE(w <= 512 AND h <= 512, FALSE) THEN 5 ELSE 6 END AS rule FROM f)
SELECT p_partkey, CASE rule WHEN 1 THEN 'LOGO' WHEN 3 THEN 'EVENT_POSTER' WHEN 4 THEN 'VENUE_IMAGE' WHEN 5 THEN 'LOGO' ELSE 'UNKNOWN' END AS kind, CAST(CASE rule WHEN 1 THEN 0.98 WHEN 2 THEN 0.45 WHEN 3 THEN 0.85 WHEN 4 THEN 0.75 WHEN 5 THEN 0.7 ELSE 0.2 END AS DOUBLE) AS score FROM k""")
def media_kinds(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    url = F.concat(F.lit("https://img.example/"), F.when(size % 5 == 0, "site-Logo.png").when(size % 5 == 1, "milonga-poster.jpg").when(size % 5 == 2, "hall.jpg").when(size % 5 == 3, "profile.png").otherwise("x.png"))
    beside = F.concat("p_name", F.when(k % 7 == 0, " party schedule").when(k % 7 == 1, " Our LOGO here").when(k % 7 == 2, " the logotype").otherwise(""))
    found = labels.media_kind(url, beside, F.when(size > 10, size * 20), size * 20 + k % 60)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("m")).select("p_partkey", "m.kind", "m.score")


@query(None)
def unresolved_clusters(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("alias"))
    return resolution.clustered(texts, places, folded_key, similarity)


@query("""SELECT p_type AS text, CAST(count(*) AS BIGINT) AS n_all, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n_live, CAST(max(l_shipdate) AS DATE) AS last_day FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY n_live DESC, n_all DESC, text""")
def unresolved_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counted = rows.groupBy(F.col("p_type").alias("text")).agg(F.count("*").alias("n_all"), F.count_if(F.col("l_returnflag") == "N").alias("n_live"), F.to_date(F.max("l_shipdate")).alias("last_day"))
    return counted.orderBy(F.desc("n_live"), F.desc("n_all"), "text")


@query("SELECT lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) AS identity, CAST(count(*) AS BIGINT) AS seen, array_to_string(list_sort(list_distinct(list(split_part(url, '/', 4)))), ',') AS sections, max(page_id) AS last_page FROM pages GROUP BY 1")
def discovery_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.lower(F.regexp_extract("url", "^(?i)https?://([^/:?#]+)", 1)).alias("identity")).agg(F.count("*").alias("seen"), F.array_join(F.sort_array(F.collect_set(F.split_part("url", F.lit("/"), F.lit(4)))), ",").alias("sections"), F.max("page_id").alias("last_page"))


@query("""WITH s AS (SELECT event_id, user_id % 20 AS host, ts FROM events) SELECT event_id, CAST(count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS spent, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) <= 20 AS within_budget FROM s""")
def host_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    counted = streaks.counted_within(rows, "host", "at", 86_400_000_000, "spent")
    return counted.select("event_id", "spent", (F.col("spent") <= 20).alias("within_budget"))
