"""Guards, scores and gates over the given tables: events stand for outcomes, users for the keys that are watched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards
from .registry import query, table

def _newest():
    return F.desc("ts"), F.desc("event_id")


_OUTCOMES = "o AS (SELECT user_id, event_id, ts, value > 100 AS predicted, event_type IN ('purchase', 'click') AS actual, value > 190 AND event_type = 'error' AS regression, value > 290 AS critical FROM events)"
_LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM o), d AS (SELECT l.*, size FROM l JOIN (SELECT unnest([{sizes}]) AS size) ON nth <= size)"


def _outcomes(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (value > 100).alias("predicted"), kind.isin("purchase", "click").alias("actual"), ((value > 190) & (kind == "error")).alias("regression"), (value > 290).alias("critical"))


@query(f"""WITH {_OUTCOMES}, {_LAST.format(sizes="5, 10, 20")},
m AS (SELECT user_id, size, count(*) AS observed, count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT actual) AS tn, count(*) FILTER (WHERE regression) AS r, count(*) FILTER (WHERE regression AND critical) AS c FROM d GROUP BY 1, 2),
p AS (SELECT *, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END, 4) AS miss, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS wrong FROM m)
SELECT user_id, CAST(size AS INTEGER) AS size, CAST(observed AS BIGINT) AS observed, miss AS miss_rate, wrong AS false_positive_rate, CAST(r AS BIGINT) AS regressions,
CASE WHEN c > 0 THEN 'ROLLBACK' WHEN observed < size THEN 'WARMING' WHEN size = 5 AND (r >= 2 OR miss >= 0.2 OR wrong >= 0.4) THEN 'ROLLBACK' WHEN size = 5 AND (r = 1 OR wrong >= 0.2) THEN 'WATCH' WHEN size = 10 AND (r >= 2 OR miss >= 0.1 OR wrong >= 0.25) THEN 'ROLLBACK' WHEN size = 20 AND (r >= 3 OR miss >= 0.1 OR wrong >= 0.2) THEN 'ROLLBACK' ELSE 'HEALTHY' END AS status FROM p""")
def runtime_guard(spark, sf_dir):
    return guards.runtime_guard(_outcomes(spark, sf_dir), "user_id", _newest())


@query("""WITH o AS (SELECT user_id, event_id, ts, value > 150 AND event_type = 'error' AS regression, value > 250 AS critical, value > 320 AND event_type = 'view' AS bad, value > 340 AND event_type = 'click' AS missed, (value - 100) / 1000 AS coverage FROM events), """ + _LAST.format(sizes="5, 10, 20") + """,
m AS (SELECT user_id, size, count(*) AS observed, count(*) FILTER (WHERE regression) AS r, count(*) FILTER (WHERE coverage < -0.1) AS lost, count(*) FILTER (WHERE (regression AND critical) OR bad OR missed) AS worst FROM d GROUP BY 1, 2)
SELECT user_id, CAST(size AS INTEGER) AS size, CAST(observed AS BIGINT) AS observed, CASE WHEN worst > 0 OR r >= CASE size WHEN 20 THEN 3 ELSE 2 END OR lost >= CASE size WHEN 20 THEN 3 ELSE 2 END THEN 'REISOLATE' WHEN observed < size THEN 'WARMING' WHEN r > 0 OR lost > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS status FROM m""")
def reintegration_guard(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", ((value > 150) & (kind == "error")).alias("regression"), (value > 250).alias("critical"), ((value > 320) & (kind == "view")).alias("false_corroboration"), ((value > 340) & (kind == "click")).alias("missed"), ((value - 100) / 1000).alias("coverage_change"))
    return guards.reintegration_guard(rows, "user_id", _newest())


@query("""WITH o AS (SELECT user_id, event_id, ts, event_type <> 'signup' AS agree, value > 250 AND event_type = 'error' AS unsafe FROM events), """ + _LAST.format(sizes="7, 14, 30") + """,
w AS (SELECT user_id, size, CASE WHEN count(*) FILTER (WHERE unsafe) > 0 THEN 'BLOCKED' WHEN count(*) >= size AND count(*) FILTER (WHERE agree) / count(*) >= 0.9 THEN 'STABLE' ELSE 'OBSERVING' END AS s FROM d GROUP BY 1, 2), p AS (SELECT user_id, max(s) FILTER (WHERE size = 7) AS a, max(s) FILTER (WHERE size = 14) AS b, max(s) FILTER (WHERE size = 30) AS c FROM w GROUP BY 1),
k AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE unsafe) > 0 THEN 'BLOCKED' WHEN count(*) < 20 OR count(*) FILTER (WHERE agree) / count(*) < 0.9 THEN 'OBSERVING' ELSE 'ELIGIBLE' END AS cum FROM o GROUP BY 1),
r AS (SELECT user_id, n, cum, CASE WHEN cum = 'BLOCKED' OR a = 'BLOCKED' OR b = 'BLOCKED' THEN 'BLOCKED' WHEN cum <> 'ELIGIBLE' OR a <> 'STABLE' OR b <> 'STABLE' THEN 'OBSERVING' WHEN n >= 30 AND c <> 'STABLE' THEN 'OBSERVING' ELSE 'ELIGIBLE' END AS s FROM k JOIN p USING (user_id))
SELECT user_id, CAST(n AS BIGINT) AS samples, cum AS cumulative, s AS status, s = 'BLOCKED' AND user_id % 2 = 0 AS downgraded FROM r""")
def rolling_stability(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", "ts", (F.col("event_type") != "signup").alias("agree"), ((F.col("value") > 250) & (F.col("event_type") == "error")).alias("unsafe"))
    before = e.select("user_id").distinct().withColumn("status", F.when(F.col("user_id") % 2 == 0, "ELIGIBLE").otherwise("OBSERVING"))
    return guards.rolling_stability(rows, "user_id", _newest(), before)


@query("""WITH c AS (SELECT s_suppkey, s_nationkey % 3 AS scope_type, s_suppkey % 10 AS source_id, s_nationkey AS platform, s_nationkey % 5 AS rule_key, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS cause, s_suppkey % 2 AS route FROM supplier),
t AS (SELECT n_nationkey, n_nationkey % 3 AS scope_type, n_nationkey % 10 AS source_id, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS platform, n_nationkey % 5 AS rule_key, CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS cause, n_regionkey % 2 AS route FROM nation)
SELECT s_suppkey, round(least(1.0, 0.15 + CASE WHEN c.scope_type = t.scope_type THEN 0.2 ELSE 0 END + CASE WHEN c.source_id = t.source_id THEN 0.2 ELSE 0 END + CASE WHEN t.platform IS NULL THEN 0.075 WHEN c.platform = t.platform THEN 0.15 ELSE 0 END + CASE WHEN c.rule_key = t.rule_key THEN 0.1 ELSE 0 END + CASE WHEN t.cause IS NULL THEN 0.05 WHEN c.cause = t.cause THEN 0.1 ELSE 0 END + CASE WHEN c.route = t.route THEN 0.1 ELSE 0 END), 6)::DOUBLE AS similarity FROM c JOIN t ON n_nationkey = platform_key(s_suppkey)""".replace("platform_key(s_suppkey)", "(s_suppkey * 7) % 25"))
def context_similarity(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    own = F.struct((n % 3).alias("scope_type"), (k % 10).alias("source_id"), n.alias("platform"), (n % 5).alias("rule_key"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("secondary_cause"), (k % 2).alias("alternative_route"))
    t = F.col("n_nationkey")
    asked = F.struct((t % 3).alias("scope_type"), (t % 10).alias("source_id"), F.when(t % 4 > 0, t).alias("platform"), (t % 5).alias("rule_key"), F.when(t % 2 == 0, 1).alias("secondary_cause"), (F.col("n_regionkey") % 2).alias("alternative_route"))
    pairs = table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("own")).join(table(spark, sf_dir, "nation").select("n_nationkey", asked.alias("asked")), (F.col("s_suppkey") * 7) % 25 == F.col("n_nationkey"))
    return pairs.select("s_suppkey", F.round(guards.context_similarity(F.col("own"), F.col("asked")), 6).alias("similarity"))


@query("""WITH p AS (SELECT l_suppkey % 25 AS family, l_partkey % 40 AS remedy, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 30) AS s, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 48) AS f, date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS days FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, s + f AS d, CASE WHEN s + f > 0 THEN greatest(0.0, (s / (s + f) + 3.8416 / (2 * (s + f)) - 1.96 * sqrt((s / (s + f) * (1 - s / (s + f)) + 3.8416 / (4 * (s + f))) / (s + f))) / (1 + 3.8416 / (s + f))) ELSE 0.0 END AS w FROM p),
q AS (SELECT *, round(greatest(0.0, least(1.0, w * 0.4 + least(days / 90.0, 1.0) * 0.2 + least(n / 5.0, 1.0) * 0.2 + CASE WHEN family = 3 THEN 0.2 ELSE 0.13 END - least(f * 0.2, 0.6))), 6) AS score FROM c)
SELECT family, remedy, score, CASE WHEN remedy = 7 OR f >= 2 THEN 'AVOID' WHEN d < 1 OR n < 2 THEN 'LOW_DATA' WHEN family = 3 AND s >= 2 AND f = 0 AND n >= 2 AND score >= 0.45 THEN 'PREFERRED' WHEN f > 0 THEN 'WATCH' ELSE 'LEARNING' END AS state FROM q""")
def family_ranking(spark, sf_dir):
    flag, quantity, day = F.col("l_returnflag"), F.col("l_quantity"), F.to_date("l_shipdate")
    profiles = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("family"), (F.col("l_partkey") % 40).alias("remedy")).agg(
        F.count("*").alias("attempts"), F.count_if((flag == "N") & (quantity > 30)).alias("sustained"), F.count_if((flag == "R") & (quantity > 48)).alias("failed"), F.datediff(F.max(day), F.min(day)).alias("survival_days")
    )
    return guards.family_ranking(profiles.withColumn("band", F.when(F.col("remedy") == 7, "AVOID")), F.lit(3))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 250), n AS (SELECT user_id, row_number() OVER (ORDER BY f, user_id) AS nth FROM (SELECT user_id, min((ts, event_id)) AS f FROM events WHERE user_id NOT IN (SELECT user_id FROM a) GROUP BY 1))
SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM a) OR nth <= 40 - (SELECT count(*) FROM a) THEN 'CANARY' ELSE 'BASE_OR_FULL' END AS mode FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN n USING (user_id)""")
def canary_assignments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return guards.canary_assignments(e, "user_id", [F.col("ts"), F.col("event_id")], e.filter("event_type = 'signup' and value > 250").select("user_id").distinct(), 40)


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED_CASE' WHEN 'P' THEN 'DISMISSED' ELSE 'ACTIVE' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'CRITICAL' ELSE 'NORMAL' END AS severity FROM orders),
e AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 45) AS unresolved, count(*) FILTER (WHERE l_returnflag <> 'A') AS causes, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linenumber <= 3) AS linked, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber <= 3) AS open FROM lineitem GROUP BY 1)
SELECT id AS cluster_id, CAST(COALESCE(unresolved, 0) AS BIGINT) AS unresolved, CAST(COALESCE(open, 0) AS BIGINT) AS open, status <> 'ACTIVE' AND COALESCE(unresolved, 0) = 0 AND (status <> 'CONFIRMED_CASE' OR COALESCE(causes, 0) > 0) AND (severity <> 'CRITICAL' OR (COALESCE(linked, 0) > 0 AND open = 0)) AS ready FROM c LEFT JOIN e USING (id)""")
def closure_gate(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "CONFIRMED_CASE").when(F.col("o_orderstatus") == "P", "DISMISSED").otherwise("ACTIVE")
    clusters = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), status.alias("status"), F.when(F.col("o_orderpriority").startswith("1"), "CRITICAL").otherwise("NORMAL").alias("severity"))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "cluster_id")
    evidence = lines.select("cluster_id", (F.col("l_linestatus") == "O").alias("active"), (F.col("l_quantity") > 45).alias("critical"))
    work = lines.filter("l_returnflag <> 'A'").select("cluster_id", F.when(F.col("l_linenumber") <= 3, F.when(F.col("l_returnflag") == "R", "OPEN").otherwise("VERIFIED")).alias("state"))
    return guards.closure(clusters, evidence, work)


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'SYNDICATED' WHEN 'click' THEN 'SYNDICATED' WHEN 'error' THEN 'INDEPENDENT' ELSE 'HOLD' END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE d = 'SYNDICATED') AS s, count(*) FILTER (WHERE d = 'INDEPENDENT') AS i FROM r WHERE k = 1)
SELECT CAST(n AS BIGINT) AS reviewed, CAST(s + i AS BIGINT) AS decisive, CASE WHEN s + i > 0 THEN round(s / (s + i), 4) END AS precision, CASE WHEN s + i > 0 THEN round(i / (s + i), 4) END AS false_positive FROM c""")
def origin_calibration(spark, sf_dir):
    kind = F.col("event_type")
    decided = F.when(kind.isin("purchase", "click"), "SYNDICATED").when(kind == "error", "INDEPENDENT").otherwise("HOLD")
    return guards.calibration(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", decided.alias("decision")), "user_id", ["ts", "event_id"])
