"""The content store over the given tables: orders stand for items, their dates for fetches, events for the fetch log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contents
from .registry import query, table

_STATES = ("NOT_FETCHED", "FETCH_FAILED", "FETCH_BLOCKED", "FETCHED_FULL", "FETCHED_PARTIAL")
_CODES = (None, "ROBOTS_DISALLOWED", "TIMEOUT", "NOT_FOUND", None, "BODY_UNAVAILABLE", "QUOTA")
_ITEMS = (
    "i AS (SELECT o_orderkey AS item_id, CASE o_orderkey * 3 % 5 "
    + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_STATES))
    + " END AS status, CASE o_custkey % 7 "
    + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES) if c)
    + """ END AS error_code, o_custkey % 4 AS attempts, CASE WHEN o_totalprice > 150000 THEN CAST(o_orderdate AS DATE) END AS next_at, CAST(o_orderdate AS DATE) AS fetched_at, CAST(o_orderdate AS DATE) + 2 AS updated_at,
CASE WHEN o_custkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) - 1 END AS reread_at, o_totalprice > 50000 AS has_text, o_orderkey % 3 AS posters, CASE o_orderstatus WHEN 'F' THEN 'v1' WHEN 'O' THEN 'v2' END AS read_by, o_orderkey % 6 AS reread_attempts,
o_totalprice > 30000 AS readable, o_custkey % 11 = 0 AS revised_since, CASE o_orderkey % 9 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'PRESERVED_BODY_LOST' WHEN 2 THEN 'KEPT_REVIEWED' END AS outcome, o_custkey % 13 = 0 AS reviewed, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 = 1 END AS body_lost, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS from_image FROM orders)"""
)


def _chosen(index, values):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _items(spark, sf_dir):
    k, c, price, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        k.alias("item_id"), _chosen(k * 3 % 5, _STATES).alias("status"), _chosen(c % 7, _CODES).alias("error_code"), (c % 4).alias("attempts"), F.when(price > 150000, day).alias("next_at"),
        day.alias("fetched_at"), F.date_add(day, 2).alias("updated_at"), F.when(c % 3 > 0, F.date_add(day, (k % 5 - 1).cast("int"))).alias("reread_at"), (price > 50000).alias("has_text"), (k % 3).alias("posters"),
        F.when(F.col("o_orderstatus") == "F", "v1").when(F.col("o_orderstatus") == "O", "v2").alias("read_by"), (k % 6).alias("reread_attempts"), (price > 30000).alias("readable"), (c % 11 == 0).alias("revised_since"),
        F.when(k % 9 == 0, "EXTRACTED").when(k % 9 == 1, "PRESERVED_BODY_LOST").when(k % 9 == 2, "KEPT_REVIEWED").alias("outcome"), (c % 13 == 0).alias("reviewed"), F.when(c % 5 > 0, c % 5 == 1).alias("body_lost"), F.when(k % 4 > 0, k % 4 == 1).alias("from_image"),
    )


_STATE = "CASE WHEN status IN ('FETCHED_FULL', 'FETCHED_PARTIAL') OR error_code IN ('ROBOTS_DISALLOWED', 'NOT_FOUND', 'LOGIN_REQUIRED') THEN 'TERMINAL' WHEN next_at IS NOT NULL THEN 'RETRYABLE' WHEN attempts = 0 THEN 'PENDING' ELSE 'TERMINAL' END"


@query(f"WITH {_ITEMS} SELECT item_id, {_STATE} AS state FROM i")
def fetch_queue_states(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", contents.queue_state(F.col("status"), F.col("error_code"), F.col("attempts"), F.col("next_at")).alias("state"))


@query(f"WITH {_ITEMS} SELECT item_id, next_at FROM i WHERE {_STATE} = 'PENDING' OR ({_STATE} = 'RETRYABLE' AND next_at <= DATE '1997-01-01') ORDER BY next_at NULLS FIRST, item_id LIMIT 2000")
def due_fetches(spark, sf_dir):
    return contents.due(_items(spark, sf_dir), "item_id", F.lit("1997-01-01").cast("date"), 2000)


_REASONS = """r AS (SELECT *, concat_ws(',', CASE WHEN status LIKE 'FETCHED%' AND has_text AND (reread_at IS NULL OR reread_at < fetched_at) THEN 'BODY_ARRIVED' END, CASE WHEN status = 'FETCH_BLOCKED' AND posters > 0 AND (reread_at IS NULL OR reread_at < updated_at) THEN 'POSTER_GAINED' END,
CASE WHEN ((status LIKE 'FETCHED%' AND has_text) OR (status = 'FETCH_BLOCKED' AND posters > 0)) AND read_by IS DISTINCT FROM 'v2' THEN 'VERSION_CHANGED' END) AS reasons FROM i)"""


@query(f"WITH {_ITEMS}, {_REASONS} SELECT item_id, reasons FROM r WHERE reasons <> '' AND reread_attempts < 3")
def reread_queue(spark, sf_dir):
    return contents.to_reread(_items(spark, sf_dir), "v2")


@query(f"""WITH {_ITEMS}, {_REASONS} SELECT CAST(count(*) FILTER (WHERE reasons <> '' AND reread_attempts < 3) AS BIGINT) AS waiting, CAST(count(*) FILTER (WHERE reasons LIKE '%BODY%' AND reread_attempts < 3) AS BIGINT) AS body_arrived, CAST(count(*) FILTER (WHERE reasons LIKE '%POSTER%' AND reread_attempts < 3) AS BIGINT) AS poster_gained,
CAST(count(*) FILTER (WHERE reasons LIKE '%VERSION%' AND reread_attempts < 3) AS BIGINT) AS version_changed, CAST(count(*) FILTER (WHERE reasons <> '' AND reread_attempts >= 3) AS BIGINT) AS given_up FROM r""")
def reread_backlog(spark, sf_dir):
    return contents.backlog(_items(spark, sf_dir), "v2")


@query(f"""WITH {_ITEMS} SELECT item_id, CASE WHEN NOT readable THEN 'NOT_EXTRACTED' WHEN read_by IS DISTINCT FROM 'v2' OR revised_since THEN CASE WHEN reread_attempts >= 3 THEN 'REEXTRACTION_FAILED' ELSE 'REEXTRACTION_PENDING' END WHEN outcome = 'EXTRACTED' THEN 'CURRENT' WHEN outcome LIKE 'PRESERVED%' THEN 'UPDATE_NOT_APPLIED' WHEN outcome = 'KEPT_REVIEWED' OR reviewed THEN 'HUMAN_DECISION_KEPT'
WHEN status <> 'FETCH_BLOCKED' THEN 'CURRENT' WHEN body_lost THEN 'UPDATE_NOT_APPLIED' WHEN from_image IS NULL OR from_image OR body_lost IS NULL THEN 'NOT_VERIFIED' ELSE 'CURRENT' END AS state FROM i""")
def extraction_freshness(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", contents.freshness("v2").alias("state"))


_ANSWER = "a AS (SELECT item_id, CASE WHEN item_id % 17 = 0 THEN 'NOT_MODIFIED' WHEN item_id % 17 = 1 THEN 'LOGIN_REQUIRED' ELSE status END AS status, attempts = 1 AS other_method, posters = 1 AS same, CASE WHEN item_id % 7 = 0 THEN 429 WHEN item_id % 7 = 1 THEN 403 WHEN item_id % 7 = 2 THEN 410 END AS http, error_code FROM i)"


@query(f"""WITH {_ITEMS}, {_ANSWER} SELECT item_id, CASE WHEN status = 'NOT_MODIFIED' THEN 'NOT_MODIFIED' WHEN status LIKE 'FETCHED%' THEN CASE WHEN other_method THEN 'ADAPTER_MISMATCH' WHEN same THEN 'UNCHANGED' ELSE 'REVISED' END WHEN error_code = 'ROBOTS_DISALLOWED' THEN 'ROBOTS_DISALLOWED' WHEN status = 'LOGIN_REQUIRED' OR http IN (401, 403) THEN 'FORBIDDEN' WHEN http = 429 THEN 'RATE_LIMITED' WHEN http IN (404, 410) THEN 'NOT_FOUND'
WHEN status = 'FETCH_BLOCKED' AND error_code NOT IN ('BODY_UNAVAILABLE', 'BLOCKED', 'NOT_FOUND') THEN 'REFUSED' WHEN error_code = 'BODY_UNAVAILABLE' THEN 'BODY_UNAVAILABLE' ELSE 'FAILED' END AS verdict FROM a""")
def refresh_verdicts(spark, sf_dir):
    k = F.col("item_id")
    status = F.when(k % 17 == 0, "NOT_MODIFIED").when(k % 17 == 1, "LOGIN_REQUIRED").otherwise(F.col("status"))
    http = F.when(k % 7 == 0, 429).when(k % 7 == 1, 403).when(k % 7 == 2, 410)
    method, digest = F.when(F.col("attempts") == 1, "post").otherwise("get"), F.when(F.col("posters") == 1, "same").otherwise("new")
    return _items(spark, sf_dir).select("item_id", contents.refresh_verdict(status, method, digest, F.lit("get"), F.lit("same"), http, F.col("error_code")).alias("verdict"))


@query("""WITH b AS (SELECT l_orderkey AS item_id, max(CAST(l_extendedprice AS BIGINT)) AS best FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), s AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_totalprice AS BIGINT) // 10 END AS stored FROM orders)
SELECT item_id, stored, best FROM s JOIN b USING (item_id) WHERE COALESCE(stored, 0) < best * 0.5""".replace("CAST(l_extendedprice AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)").replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def lost_bodies(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 4 > 0, F.floor(F.floor("o_totalprice") / 10)).alias("length"))
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.when(F.col("l_returnflag") == "N", "FETCHED_FULL").when(F.col("l_returnflag") == "R", "FETCHED_PARTIAL").otherwise("FETCH_FAILED").alias("outcome"), F.floor("l_extendedprice").alias("length"))
    return contents.lost_bodies(items, log)


@query("""SELECT CAST(ts AS DATE) AS day, 'host' || (user_id % 9) AS host, CAST(count(*) AS BIGINT) AS asked, CAST(count(*) FILTER (WHERE event_type IN ('view', 'click')) AS BIGINT) AS fetched, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS chars, round(avg(event_id % 900), 2) AS mean_ms FROM events GROUP BY 1, 2""")
def fetch_stats(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind == "view", "FETCHED_FULL").when(kind == "click", "FETCHED_PARTIAL").otherwise("FETCH_FAILED")
    log = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.concat(F.lit("host"), (F.col("user_id") % 9).cast("string")).alias("host"), outcome.alias("outcome"), F.floor(F.col("value") * 100).alias("length"), (F.col("event_id") % 900).alias("ms"))
    return contents.fetch_stats(log)
