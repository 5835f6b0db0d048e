"""Quality, freshness, yield, usage, windows over the events log, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import percentage, priced, ratio, reliability, shrunken_rate, wilson_low
from ..operators import metrics, streaks
from .registry import query, table
from .shapes import EVENTS_SQL, events

_FIELDS = {"genre": "genre IS NOT NULL", "region": "region IS NOT NULL", "time": "start_min IS NOT NULL", "end": "end_date IS NOT NULL", "fee": "fee > 1000"}


@query(
    f"WITH {EVENTS_SQL}, c AS (SELECT CAST(count(*) AS BIGINT) AS total, "
    + ", ".join(f'CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS "with_{k}"' for k, c in _FIELDS.items())
    + " FROM ev) SELECT *, "
    + ", ".join(f'total - "with_{k}" AS "missing_{k}"' for k in _FIELDS)
    + " FROM c"
)
def completeness(spark, sf_dir):
    return metrics.completeness(events(spark, sf_dir), {k: F.expr(c) for k, c in _FIELDS.items()})


@query("SELECT r_name AS region, c_mktsegment AS genre, CAST(count(c_custkey) FILTER (WHERE c_acctbal > 9000) AS BIGINT) AS n FROM (SELECT DISTINCT r_regionkey, r_name FROM region) CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) s LEFT JOIN (SELECT customer.*, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON n_regionkey = r_regionkey AND c_mktsegment = seg GROUP BY 1, 2")
def coverage_grid(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = customers.select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("genre"), "c_acctbal")
    axes = table(spark, sf_dir, "region").select(F.col("r_name").alias("region")), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("genre"))
    return metrics.dense_grid(rows.filter("c_acctbal > 9000"), ("region", "genre"), axes)


@query(f"""WITH {EVENTS_SQL} SELECT COALESCE(region, 'UNKNOWN') AS region, CAST(count(*) FILTER (WHERE event_date = DATE '1998-06-03') AS BIGINT) AS d0, CAST(count(*) FILTER (WHERE event_date BETWEEN DATE '1998-06-03' AND DATE '1998-06-10') AS BIGINT) AS d7,
CAST(count(*) FILTER (WHERE event_date BETWEEN DATE '1998-06-03' AND DATE '1998-07-03') AS BIGINT) AS d30, max(event_date) AS last_date, CAST(greatest(0, date_diff('day', DATE '1998-06-03', max(event_date))) AS BIGINT) AS runway_days FROM ev WHERE canonical_id IS NULL GROUP BY 1""")
def regional_supply(spark, sf_dir):
    today = F.lit("1998-06-03").cast("date")
    within = lambda n: F.count_if(F.col("event_date").between(today, F.date_add(today, n)))
    rows = events(spark, sf_dir).filter("canonical_id is null").groupBy(F.coalesce("region", F.lit("UNKNOWN")).alias("region"))
    return rows.agg(within(0).alias("d0"), within(7).alias("d7"), within(30).alias("d30"), F.max("event_date").alias("last_date"), F.greatest(F.lit(0), F.datediff(F.max("event_date"), today)).cast("long").alias("runway_days"))


@query("""WITH p AS (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS passed FROM events)
SELECT user_id, CAST(count(*) FILTER (WHERE passed = 0) AS BIGINT) AS streak FROM p GROUP BY user_id""")
def failure_streak(spark, sf_dir):
    return streaks.failure_streak(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error")


_W = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


@query("SELECT event_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({_W.format(n=n - 1)}) AS BIGINT) AS hits_{n}, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({_W.format(n=n - 1)}) / count(*) OVER ({_W.format(n=n - 1)}), 4) AS rate_{n}" for n in (7, 14, 30)) + " FROM events")
def rolling_rates(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return streaks.trailing(log, "user_id", [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error", (7, 14, 30)).select("event_id", *[f"{k}_{n}" for n in (7, 14, 30) for k in ("hits", "rate")])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, """ + ", ".join(f"CAST(count(*) FILTER (WHERE k <= {n}) AS BIGINT) AS rows_{n}, round(count(*) FILTER (WHERE k <= {n} AND event_type = 'error') / count(*) FILTER (WHERE k <= {n}), 4) AS rate_{n}" for n in (5, 10, 20)) + " FROM r GROUP BY user_id")
def recent_windows(spark, sf_dir):
    return streaks.recent_rates(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error", (5, 10, 20))


@query("""WITH s AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), w AS (SELECT event_id,
count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS b FROM s)
SELECT event_id, CAST(a AS BIGINT) AS within_3600, CAST(b AS BIGINT) AS within_86400, (a <= 2 AND b <= 5) AS allowed FROM w""")
def rate_limits(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return streaks.rate_limited(log, "user_id", F.col("sec"), [(2, 3600), (5, 86400)]).select("event_id", "within_3600", "within_86400", "allowed")


@query("""WITH s AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, ts FROM events)
SELECT event_id, COALESCE(sec - lag(sec) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 600, FALSE) AS duplicate FROM s""")
def duplicate_suppression(spark, sf_dir):
    return streaks.repeats(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], F.unix_seconds(F.col("ts").cast("timestamp")), 600).select("event_id", "duplicate")


@query("SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS ordinal, row_number() OVER w > 1 AS recurrent FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def recurrence_ordinals(spark, sf_dir):
    return streaks.ordinals(table(spark, sf_dir, "events").filter("event_type = 'error'"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "ordinal", "recurrent")


@query("""WITH f AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS fail FROM events), b AS (SELECT *, sum(1 - fail) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM f),
r AS (SELECT *, sum(fail) OVER (PARTITION BY user_id, block ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b), l AS (SELECT *, COALESCE(lag(run) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM r),
g AS (SELECT user_id, block, list(struct_pack(s := CAST(floor(epoch(ts)) AS BIGINT), id := event_id) ORDER BY ts, event_id) AS late FROM r WHERE run >= 3 GROUP BY 1, 2),
t AS (SELECT user_id, block, list_reduce(late, lambda said, x: CASE WHEN x.s >= said[-1].s + 21600 THEN list_append(said, x) ELSE said END, late[1:1]) AS said FROM g),
n AS (SELECT unnest(list_transform(said, lambda x: x.id)) AS event_id, unnest(range(len(said))) AS k FROM t)
SELECT event_id, CAST(run AS BIGINT) AS run, CASE WHEN k = 0 THEN 'ALERT' WHEN k > 0 THEN 'REMINDER' WHEN run = 0 AND before >= 3 THEN 'RECOVERED' END AS alert FROM l LEFT JOIN n USING (event_id)""")
def alert_hysteresis(spark, sf_dir):
    return streaks.alerts(table(spark, sf_dir, "events"), "user_id", [F.asc("ts"), F.asc("event_id")], F.col("event_type").isin("error", "view"), F.unix_timestamp(F.col("ts").cast("timestamp")), 3).select("event_id", "run", "alert")


@query("""WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM c""")
def context_segments(spark, sf_dir):
    return streaks.spans_of(table(spark, sf_dir, "conversations"), "conv_id", [F.asc("turn")], F.col("role")).select("conv_id", "turn", "part")


@query("""SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(avg(value), 4) AS mean_value FROM events GROUP BY ROLLUP (event_type)""")
def observation_metrics(spark, sf_dir):
    aggs = [F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value")]
    return metrics.overall_and_by(table(spark, sf_dir, "events"), "event_type", aggs)


@query("""WITH j AS (SELECT quality = 1 AS actual, n_chars >= 400 AS predicted FROM labels JOIN documents USING (doc_id)), c AS (SELECT CAST(count(*) FILTER (WHERE actual AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT actual AND predicted) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE actual AND NOT predicted) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT actual AND NOT predicted) AS BIGINT) AS tn FROM j)
SELECT *, round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END, 4) AS recall, COALESCE(round(CASE WHEN fp + tn <> 0 THEN fp / (fp + tn) END, 4), 0.0) AS fpr, COALESCE(round(CASE WHEN tp + fn <> 0 THEN fn / (tp + fn) END, 4), 0.0) AS miss FROM c""")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.confusion(rows, F.col("quality") == 1, F.col("n_chars") >= 400)


_CUTS = (200, 400, 800, 1600, 3200)


@query("WITH j AS (SELECT quality = 1 AS actual, n_chars FROM labels JOIN documents USING (doc_id)), c AS (" + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, CAST(count(*) FILTER (WHERE n_chars >= {t} AND actual) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE n_chars >= {t} AND NOT actual) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE n_chars < {t} AND actual) AS BIGINT) AS fn FROM j" for t in _CUTS) + ") SELECT *, round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END, 4) AS recall FROM c")
def threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.threshold_sweep(rows, "n_chars", F.col("quality") == 1, _CUTS)


@query("""WITH p AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 4) AS agreement FROM events GROUP BY user_id)
SELECT user_id, n, errors, agreement, CASE WHEN errors > 20 THEN 'BLOCKED' WHEN n < 60 OR agreement < 0.2 THEN 'OBSERVING' ELSE 'ELIGIBLE' END AS band,
concat_ws(',', CASE WHEN errors > 20 THEN 'UNSAFE' END, CASE WHEN n < 60 THEN 'FEW' END, CASE WHEN agreement < 0.2 THEN 'DISAGREES' END) AS reasons, NOT (errors > 20 OR n < 60 OR agreement < 0.2) AS ready FROM p""")
def policy_gate(spark, sf_dir):
    measures = {"n": F.count("*"), "errors": F.count_if(F.col("event_type") == "error"), "agreement": F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 4)}
    unsafe, few, apart = F.col("errors") > 20, F.col("n") < 60, F.col("agreement") < 0.2
    return metrics.profile_gate(table(spark, sf_dir, "events"), ["user_id"], measures, [("BLOCKED", unsafe), ("OBSERVING", few | apart)], "ELIGIBLE", [(unsafe, "UNSAFE"), (few, "FEW"), (apart, "DISAGREES")])


@query("""WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS s FROM events GROUP BY user_id)
SELECT user_id, round(greatest(0.0, (s / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((s / n * (1 - s / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)), 4) AS wilson, round((s + 1.0) / (n + 2.0), 4) AS bayes, round(CAST(greatest(0.2, least(1.0, 1.0 - 0.2 * (n - s) + 0.025 * s)) AS DOUBLE), 4) AS reliability FROM c""")
def reliability_scores(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("s"))
    n, s = F.col("n"), F.col("s")
    return counted.select("user_id", F.round(wilson_low(s, n), 4).alias("wilson"), F.round(shrunken_rate(s, n), 4).alias("bayes"), F.round(reliability(n - s, s), 4).alias("reliability"))


@query("""WITH d AS (SELECT event_type AS provider, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY 1, 2)
SELECT provider, day, requests, CAST(sum(requests) OVER (PARTITION BY provider ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS month_to_date, ceil(greatest(sum(requests) OVER (PARTITION BY provider ORDER BY day ROWS UNBOUNDED PRECEDING) - 500, 0) / 100) * 0.25 AS cost, requests > 80 AS over_quota FROM d""")
def usage_cost(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider"), F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"))
    so_far = F.sum("requests").over(Window.partitionBy("provider").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("month_to_date", so_far).select("*", priced(F.col("month_to_date"), 500, 100, 0.25).alias("cost"), (F.col("requests") > 80).alias("over_quota"))


@query("""WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS viewed, count(*) FILTER (WHERE event_type = 'click') AS clicked, count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM events GROUP BY user_id)
SELECT user_id, CAST(viewed AS BIGINT) AS viewed, CAST(clicked AS BIGINT) AS clicked, CAST(bought AS BIGINT) AS bought, round(CASE WHEN viewed <> 0 THEN clicked / viewed END, 4) AS click_rate, round(CASE WHEN clicked <> 0 THEN bought / clicked END, 4) AS buy_rate, round_even(CASE WHEN viewed <> 0 THEN bought * 100.0 / viewed END, 0) AS bought_percent FROM f""")
def funnel(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in (("view", "viewed"), ("click", "clicked"), ("purchase", "bought"))])
    return counts.select("*", ratio("clicked", "viewed").alias("click_rate"), ratio("bought", "clicked").alias("buy_rate"), percentage("bought", "viewed").alias("bought_percent"))


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'l_linestatus' WHEN grouping(l_linestatus) = 1 THEN 'l_returnflag' ELSE 'l_returnflag+l_linestatus' END AS grouping, concat_ws('|', l_returnflag, l_linestatus) AS name, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS score
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus)) ORDER BY score DESC, grouping, name LIMIT 10""")
def correction_hotspots(spark, sf_dir):
    return metrics.hotspots(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity"), 10)


@query("""WITH m AS (SELECT user_id AS key, event_type AS metric, CAST(ts AS DATE) < DATE '2024-01-16' AS old, avg(value) AS value FROM events GROUP BY 1, 2, 3), d AS (SELECT a.key, a.metric, round(b.value - a.value, 4) AS delta FROM m a JOIN m b ON a.key = b.key AND a.metric = b.metric AND a.old AND NOT b.old),
e AS (SELECT *, abs(delta) >= 0.01 AS moved, (CASE WHEN metric = 'error' THEN -delta ELSE delta END) > 0 AS better, abs(delta) * CASE metric WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 0.5 ELSE 1.0 END AS impact FROM d),
s AS (SELECT key, count(*) AS comparable, COALESCE(sum(impact) FILTER (WHERE moved AND better), 0) AS gain, COALESCE(sum(impact) FILTER (WHERE moved AND NOT better), 0) AS loss, count(*) FILTER (WHERE moved) AS moved, count(*) FILTER (WHERE moved AND NOT better AND metric = 'purchase') > 0 AS veto FROM e GROUP BY key),
r AS (SELECT *, CASE WHEN gain + loss > 0 THEN round((gain - loss) / (gain + loss), 4) ELSE 0.0 END AS score FROM s)
SELECT key, CAST(comparable AS BIGINT) AS comparable, score, CASE WHEN comparable < 2 OR moved = 0 THEN 'INCONCLUSIVE' WHEN score >= 0.25 THEN CASE WHEN veto THEN 'INCONCLUSIVE' ELSE 'IMPROVED' END WHEN score <= -0.25 THEN 'REGRESSED' ELSE 'INCONCLUSIVE' END AS verdict FROM r""")
def change_verdict(spark, sf_dir):
    phased = table(spark, sf_dir, "events").withColumn("old", F.to_date("ts") < F.lit("2024-01-16").cast("date"))
    means = phased.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("metric"), "old").agg(F.avg("value").alias("value"))
    return metrics.weighted_verdict(means.filter("old").drop("old"), means.filter("not old").drop("old"), {"purchase": 2.0, "error": 0.5}, ["error"])


_RULES = {"price_positive": "o_totalprice > 0", "status_known": "o_orderstatus IN ('O', 'F', 'P')", "dated": "o_orderdate IS NOT NULL", "cheap": "o_totalprice < 300000"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(count(*) FILTER (WHERE NOT ({c})) AS BIGINT) AS n FROM orders" for k, c in _RULES.items()))
def constraint_violations(spark, sf_dir):
    return metrics.violations(table(spark, sf_dir, "orders"), {k: F.expr(c) for k, c in _RULES.items()})


@query("""WITH t AS (SELECT o_custkey AS source_id, list_distinct(list(CASE WHEN o_orderpriority LIKE '1%' THEN 'PRIMARY' WHEN o_orderpriority LIKE '2%' THEN 'OFFICIAL' ELSE 'OTHER' END)) AS tiers FROM orders GROUP BY 1)
SELECT tier, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(tiers) AS tier FROM t) GROUP BY tier""")
def evidence_tiers(spark, sf_dir):
    tier = F.when(F.col("o_orderpriority").startswith("1"), "PRIMARY").when(F.col("o_orderpriority").startswith("2"), "OFFICIAL").otherwise("OTHER")
    sets = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.collect_set(tier).alias("tiers"))
    return sets.select(F.explode("tiers").alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_ok, max(ts) AS last_any, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN last_ok IS NULL THEN 'FAILED' WHEN last_ok < TIMESTAMP '2024-01-30 00:00:00' THEN 'STALE' WHEN errors * 4 > n THEN 'DEGRADED' WHEN last_any > last_ok THEN 'PARTIAL' ELSE 'HEALTHY' END AS state FROM s""")
def source_state(spark, sf_dir):
    ok = F.when(F.col("event_type") != "error", F.col("ts"))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(ok).alias("last_ok"), F.max("ts").alias("last_any"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    fresh = F.lit("2024-01-30 00:00:00").cast("timestamp")
    state = F.when(F.col("last_ok").isNull(), "FAILED").when(F.col("last_ok") < fresh, "STALE").when(F.col("errors") * 4 > F.col("n"), "DEGRADED").when(F.col("last_any") > F.col("last_ok"), "PARTIAL").otherwise("HEALTHY")
    return s.select("user_id", state.alias("state"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) // 20 AS bucket, CAST(count(*) AS BIGINT) AS n, round(median(value), 4) AS median_value FROM events GROUP BY 1, 2""")
def json_buckets(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(k / 20).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.median("value"), 4).alias("median_value"))


@query("""SELECT o_orderkey, CAST(least(120, CASE WHEN o_orderpriority LIKE '1%' THEN 60 WHEN o_orderpriority LIKE '2%' THEN 40 ELSE 20 END + CASE WHEN o_orderstatus = 'P' THEN 30 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 40 ELSE 0 END) AS BIGINT) AS score, least(o_orderdate + INTERVAL 72 HOUR, last - INTERVAL 2 HOUR) AS due FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def evidence_priority(spark, sf_dir):
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    base = F.when(F.col("o_orderpriority").startswith("1"), 60).when(F.col("o_orderpriority").startswith("2"), 40).otherwise(20)
    score = F.least(F.lit(120), base + F.when(F.col("o_orderstatus") == "P", 30).otherwise(0) + F.when(F.col("o_totalprice") > 200000, 40).otherwise(0))
    return rows.select("o_orderkey", score.cast("long").alias("score"), F.least(F.expr("o_orderdate + INTERVAL 72 HOURS"), F.expr("last - INTERVAL 2 HOURS")).alias("due"))
