"""Search, facets, calendar, lookups, queues."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import window
from ..operators import metrics, search
from .registry import query, table
from .shapes import EVENTS_SQL, MORE_GENRES_SQL, events, more_genres

TODAY = dt.date(1998, 6, 3)
_OPEN = "canonical_id IS NULL AND COALESCE(end_date, event_date) >= DATE '1998-06-03' AND event_date <= DATE '1998-07-03' AND COALESCE(status NOT IN ('CANCELLED', 'COMPLETED'), TRUE)"
_RANK = "CASE tier WHEN 'PRIMARY' THEN 0 WHEN 'OFFICIAL' THEN 1 WHEN 'COMMUNITY' THEN 2 ELSE 3 END"


@query(f"WITH {EVENTS_SQL}, {MORE_GENRES_SQL} SELECT event_id, event_date, end_date, CAST(start_min AS BIGINT) AS start_min, genre, region, status, tier FROM ev WHERE {_OPEN} AND region IN ('ASIA', 'EUROPE') AND (genre = 'BUILDING' OR EXISTS (SELECT 1 FROM more WHERE more.event_id = ev.event_id)) ORDER BY event_date, start_min NULLS LAST, {_RANK}, event_id LIMIT 50")
def search_page(spark, sf_dir):
    first, last = window("upcoming", TODAY)
    found = search.matching(events(spark, sf_dir), first, last, genres=["BUILDING"], regions=["ASIA", "EUROPE"], more_genres=more_genres(spark, sf_dir))
    return search.page(found, 50, 1).select("event_id", "event_date", "end_date", F.col("start_min").cast("long").alias("start_min"), "genre", "region", "status", "tier")


@query(f"WITH {EVENTS_SQL} SELECT event_id, event_date, status FROM ev WHERE {_OPEN} ORDER BY event_date, start_min NULLS LAST, {_RANK}, event_id LIMIT 20 OFFSET 40")
def search_third_page(spark, sf_dir):
    first, last = window("upcoming", TODAY)
    return search.page(search.matching(events(spark, sf_dir), first, last), 20, 3).select("event_id", "event_date", "status")


@query(f"WITH {EVENTS_SQL}, {MORE_GENRES_SQL} SELECT CAST(count(*) AS BIGINT) AS n FROM ev WHERE {_OPEN} AND region IN ('ASIA', 'EUROPE') AND (genre = 'BUILDING' OR EXISTS (SELECT 1 FROM more WHERE more.event_id = ev.event_id))")
def search_count(spark, sf_dir):
    first, last = window("upcoming", TODAY)
    return search.matching(events(spark, sf_dir), first, last, genres=["BUILDING"], regions=["ASIA", "EUROPE"], more_genres=more_genres(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, event_date FROM ev WHERE canonical_id IS NULL AND COALESCE(end_date, event_date) >= DATE '1998-06-06' AND event_date <= DATE '1998-06-07' AND status IN ('VERIFIED', 'COMPLETED')")
def search_weekend_by_status(spark, sf_dir):
    return search.matching(events(spark, sf_dir), *window("weekend", TODAY), statuses=["VERIFIED", "COMPLETED"]).select("event_id", "event_date")


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE FALSE")
def search_empty_list_admits_nothing(spark, sf_dir):
    return search.matching(events(spark, sf_dir), *window("upcoming", TODAY), genres=[]).select("event_id")


@query(f"WITH {EVENTS_SQL} SELECT COALESCE(genre, 'UNKNOWN') AS genre, CAST(count(*) AS BIGINT) AS n FROM ev WHERE {_OPEN} GROUP BY 1")
def facet_genre(spark, sf_dir):
    return search.facet(search.matching(events(spark, sf_dir), *window("upcoming", TODAY)), "genre")


@query(f"WITH {EVENTS_SQL} SELECT COALESCE(region, 'UNKNOWN') AS region, CAST(count(*) AS BIGINT) AS n FROM ev WHERE {_OPEN} GROUP BY 1")
def facet_region(spark, sf_dir):
    return search.facet(search.matching(events(spark, sf_dir), *window("upcoming", TODAY)), "region")


@query(f"""WITH {EVENTS_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '1998-06-01', DATE '1998-06-28', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, CAST(count(event_id) AS BIGINT) AS n FROM days LEFT JOIN (SELECT * FROM ev WHERE canonical_id IS NULL AND COALESCE(status <> 'CANCELLED', TRUE)) e ON day BETWEEN e.event_date AND COALESCE(e.end_date, e.event_date) GROUP BY day""")
def calendar_counts(spark, sf_dir):
    return search.calendar(events(spark, sf_dir), dt.date(1998, 6, 1), dt.date(1998, 6, 28))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN start_min IS NOT NULL THEN lpad(CAST((start_min // 60) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_min % 60 AS VARCHAR), 2, '0') END AS clock, COALESCE(genre, 'UNKNOWN') AS genre_label, CAST(date_diff('day', event_date, COALESCE(end_date, event_date)) + 1 AS BIGINT) AS days FROM ev""")
def presented_events(spark, sf_dir):
    return search.presented(events(spark, sf_dir)).select("event_id", "clock", "genre_label", "days")


@query(f"WITH {EVENTS_SQL} SELECT event_id AS asked, COALESCE(canonical_id, event_id) AS event_id FROM ev WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def lookup_with_redirect(spark, sf_dir):
    return search.redirected(_asked(spark, sf_dir), events(spark, sf_dir))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("event_id")).distinct()


@query(f"WITH {EVENTS_SQL} SELECT source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS k FROM ev) WHERE k = 1")
def first_event_of_source(spark, sf_dir):
    return search.latest(events(spark, sf_dir), ["source_id"], [F.asc("event_id")]).select("source_id", "event_id")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_order_of_customer(spark, sf_dir):
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_orderstatus")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON TRUE")
def lateral_dearest_order(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT n_name, list_aggregate(list_sort(list(c_mktsegment) FILTER (WHERE c_mktsegment IS NOT NULL)), 'string_agg', ',') AS segments FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) ON n_nationkey = c_nationkey GROUP BY n_name")
def bridge_arrays(spark, sf_dir):
    bridge = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))
    return table(spark, sf_dir, "nation").join(bridge, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.nullif("segments", F.lit("")).alias("segments"))


_QUEUE = {
    "all": "TRUE",
    "upcoming": "event_date >= DATE '1998-06-03'",
    "today": "event_date = DATE '1998-06-03'",
    "tomorrow": "event_date = DATE '1998-06-04'",
    "week": "event_date BETWEEN DATE '1998-06-03' AND DATE '1998-06-10'",
    "unknown_time": "start_min IS NULL",
    "unknown_end": "end_date IS NULL",
    "folded": "canonical_id IS NOT NULL",
    "over": "status = 'COMPLETED'",
}


@query(f"WITH {EVENTS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS n FROM ev" for k, c in _QUEUE.items()))
def queue_filter_counts(spark, sf_dir):
    return metrics.filter_counts(events(spark, sf_dir), {k: F.expr(c) for k, c in _QUEUE.items()})


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def queue_pending(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def queue_reviewed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, CAST(CASE WHEN status = 'POSSIBLE' AND event_date >= DATE '1998-06-03' THEN 1 WHEN start_min IS NULL THEN 2 WHEN end_date IS NULL THEN 3 ELSE 4 END AS BIGINT) AS priority FROM ev WHERE canonical_id IS NULL
ORDER BY priority, (event_date < DATE '1998-06-03'), abs(date_diff('day', DATE '1998-06-03', event_date)), event_id LIMIT 100""")
def review_priority(spark, sf_dir):
    priority = F.when((F.col("status") == "POSSIBLE") & (F.col("event_date") >= F.lit(TODAY)), 1).when(F.col("start_min").isNull(), 2).when(F.col("end_date").isNull(), 3).otherwise(4).cast("long")
    rows = events(spark, sf_dir).filter("canonical_id is null").withColumn("priority", priority)
    return rows.orderBy("priority", F.col("event_date") < F.lit(TODAY), F.abs(F.datediff("event_date", F.lit(TODAY))), "event_id").limit(100).select("event_id", "priority")


@query(f"WITH {EVENTS_SQL} SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id FROM ev WHERE status = 'POSSIBLE' WINDOW w AS (PARTITION BY region ORDER BY event_date, event_id)")
def queue_neighbours(spark, sf_dir):
    w = Window.partitionBy("region").orderBy("event_date", "event_id")
    return events(spark, sf_dir).filter("status = 'POSSIBLE'").select("event_id", F.lag("event_id").over(w).alias("previous_id"), F.lead("event_id").over(w).alias("next_id"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey > 5000").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@query("SELECT s_suppkey, o_orderkey, l_extendedprice FROM (SELECT l_suppkey AS s_suppkey, l_orderkey AS o_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def top_three_per_supplier(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("k", rank).filter("k <= 3").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
