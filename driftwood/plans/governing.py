"""Governance policies, sources and places over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import shrunken_rate, wilson_low
from ..operators import policies, streaks
from ..sources import pages as parsers
from .registry import query, table

_OBSERVED = "o AS (SELECT user_id, event_type IN ('purchase', 'click', 'view') AS agree, event_type = 'error' AND value > 150 AS unsafe, event_type = 'error' AS harmful, event_type = 'purchase' AS helpful, CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) // 3600 AS BIGINT) AS hours, CAST(ts AS DATE) AS day FROM events)"


def _observed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, v = F.col("event_type"), F.col("value")
    hours = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("long")
    return e.select("user_id", t.isin("purchase", "click", "view").alias("agree"), ((t == "error") & (v > 150)).alias("unsafe"), (t == "error").alias("harmful"), (t == "purchase").alias("helpful"), hours.alias("hours"), F.to_date("ts").alias("day"))


def _catalogue_sql() -> str:
    parts = []
    for name, p in policies.POLICIES.items():
        measures = ", ".join(f"{v} AS {k}" for k, v in p.measures.items())
        bands = " ".join(f"WHEN {c} THEN '{b}'" for b, c in p.bands)
        reasons = ", ".join(f"CASE WHEN COALESCE({c}, TRUE) THEN '{r}' END" for c, r in p.blocks)
        closed = " OR ".join(f"COALESCE({c}, TRUE)" for c, _ in p.blocks)
        parts.append(f"SELECT '{name}' AS policy, user_id, CASE {bands} ELSE '{p.otherwise}' END AS band, concat_ws(',', {reasons}) AS reasons, NOT ({closed}) AS ready FROM (SELECT user_id, {measures} FROM o GROUP BY user_id)")
    return f"WITH {_OBSERVED} " + " UNION ALL ".join(parts)


@query(_catalogue_sql())
def policy_catalogue(spark, sf_dir):
    return policies.catalogue(_observed(spark, sf_dir), "user_id")


@query(f"""WITH {_OBSERVED}, c AS (SELECT day, user_id, count(*) AS n, count(*) FILTER (WHERE helpful) AS h, max(hours) AS hours FROM o GROUP BY 1, 2),
s AS (SELECT day, user_id AS plan, n, round(0.35 * greatest(0.0, (h / n + 3.8416 / (2 * n) - 1.96 * sqrt((h / n * (1 - h / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) + 0.15 * ((h + 1.0) / (n + 2.0)) + 0.15 * least(hours / 24.0 / 90.0, 1.0) + 0.2 * 0.8 + 0.15 * least(n / 10.0, 1.0) - 0.15 * 0.1 - 0.05 * (user_id % 3), 6) AS score FROM c),
r AS (SELECT *, row_number() OVER w AS rank, round(score - lead(score) OVER w, 6) AS margin FROM s WINDOW w AS (PARTITION BY day ORDER BY score DESC, plan))
SELECT day, plan, score, CAST(rank AS BIGINT) AS rank, CASE WHEN rank = 1 AND n >= 3 AND score >= 0.45 AND COALESCE(margin >= 0.08, TRUE) THEN 'PREFERRED' WHEN n < 3 THEN 'LOW_DATA' ELSE 'LEARNING' END AS status FROM r""")
def contextual_ranking(spark, sf_dir):
    counted = _observed(spark, sf_dir).groupBy("day", "user_id").agg(F.count("*").alias("decisive"), F.count_if("helpful").alias("h"), F.max("hours").alias("hours"))
    plans = counted.select("day", F.col("user_id").alias("plan"), "decisive", wilson_low(F.col("h"), F.col("decisive")).alias("wilson"), shrunken_rate(F.col("h"), F.col("decisive")).alias("bayes"), (F.col("hours") / 24.0).alias("survival_days"), F.lit(0.8).alias("context"), F.least(F.col("decisive") / 10.0, F.lit(1.0)).alias("evidence"), F.lit(0.1).alias("severity"), (F.col("user_id") % 3).alias("steps"))
    return policies.contextual_ranking(plans, "day")


@query("""WITH m AS (SELECT user_id AS key, avg(value) FILTER (WHERE event_type = 'purchase') AS recommended, avg(value) FILTER (WHERE event_type = 'click') AS selected FROM events GROUP BY 1)
SELECT key, round(greatest(0.0, recommended - selected), 6) AS regret, CASE WHEN recommended > selected THEN 'OVERRIDE_WORSE' WHEN selected > recommended THEN 'OVERRIDE_BETTER' ELSE 'EVEN' END AS outcome FROM m""")
def recommendation_regret(spark, sf_dir):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return policies.regret(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(mean("purchase").alias("recommended"), mean("click").alias("selected")))


@query("""WITH r AS (SELECT s_suppkey AS rule_id, DATE '2026-01-01' + CAST(s_suppkey % 7 AS INTEGER) AS first_day, DATE '2026-01-01' + CAST(30 + s_suppkey % 40 AS INTEGER) AS until, s_name AS title, CAST(s_suppkey % 24 * 60 AS INTEGER) AS start_min FROM supplier),
d AS (SELECT rule_id, CAST(unnest(generate_series(first_day, least(until, DATE '2026-02-15'), INTERVAL 7 DAY)) AS DATE) AS day, title, start_min FROM r),
o AS (SELECT n_nationkey * 4 AS rule_id, DATE '2026-01-01' + CAST((n_nationkey * 4) % 7 + 7 AS INTEGER) AS day, n_nationkey % 3 = 0 AS cancelled, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS title, CASE WHEN n_nationkey % 3 = 2 THEN 61 END AS start_min FROM nation)
SELECT d.rule_id, d.day, COALESCE(o.title, d.title) AS title, CAST(COALESCE(o.start_min, d.start_min) AS BIGINT) AS start_min FROM d LEFT JOIN o ON d.rule_id = o.rule_id AND d.day = o.day WHERE NOT COALESCE(o.cancelled, FALSE)""")
def calendar_occurrences(spark, sf_dir):
    k = F.col("s_suppkey")
    first = F.lit("2026-01-01").cast("date")
    rules = table(spark, sf_dir, "supplier").select(k.alias("rule_id"), F.date_add(first, (k % 7).cast("int")).alias("first_day"), F.date_add(first, (30 + k % 40).cast("int")).alias("until"), F.col("s_name").alias("title"), (k % 24 * 60).cast("int").alias("start_min"))
    n = F.col("n_nationkey")
    overrides = table(spark, sf_dir, "nation").select((n * 4).cast("long").alias("rule_id"), F.date_add(first, (n * 4) % 7 + 7).alias("day"), (n % 3 == 0).alias("cancelled"), F.when(n % 3 == 1, F.col("n_name")).alias("title"), F.when(n % 3 == 2, 61).alias("start_min"))
    found = parsers.occurrences(rules, overrides, F.lit("2026-02-15").cast("date"))
    return found.withColumn("start_min", F.col("start_min").cast("long"))


@query("""WITH inc AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'again' FROM customer WHERE c_custkey % 30 = 1), s AS (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0),
g AS (SELECT c_custkey, count(*) AS n, min(seg) AS seg FROM inc GROUP BY 1) SELECT g.c_custkey, CASE WHEN g.n > 1 THEN 'ERROR' WHEN s.c_custkey IS NULL THEN 'CREATE' WHEN s.seg = g.seg THEN 'SKIP' ELSE 'UPDATE' END AS action FROM g LEFT JOIN s USING (c_custkey)""")
def import_preview(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    incoming = c.filter(k % 3 != 0).select("c_custkey", F.when(k % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("seg")).unionAll(c.filter(k % 30 == 1).select("c_custkey", F.lit("again").alias("seg")))
    return parsers.csv_changes(incoming, c.filter(k % 2 == 0).select("c_custkey", F.col("c_mktsegment").alias("seg")), "c_custkey", ["seg"])


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) AS host, regexp_extract(url, '(?i)^https?://[^/?#]+(/[^#]*)', 1) AS target FROM pages)
SELECT host, target, NOT (target LIKE '/fr/%' AND NOT target LIKE '/fr/8%') AND NOT regexp_matches(target, '\\?page=1') AS allowed FROM p GROUP BY ALL""")
def robots_verdicts(spark, sf_dir):
    url = F.col("url")
    urls = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract(url, "^(?i)https?://([^/:?#]+)", 1)).alias("host"), F.regexp_extract(url, "^(?i)https?://[^/?#]+(/[^#]*)", 1).alias("target")).distinct()
    listed = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(allow).alias("allow")) for path, allow in (("/fr/", False), ("/fr/8", True), ("/*?page=1", False))])
    rules = urls.select("host").distinct().select("host", F.explode(listed).alias("r")).select("host", "r.path", "r.allow")
    return parsers.robots_allowed(rules, urls)


@query("""WITH l AS (SELECT r_name AS lane, n_name || ' ' || r_name AS q, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT lane, q, CAST(row_number() OVER (ORDER BY k, lane) AS BIGINT) AS place FROM l QUALIFY place <= 12""")
def query_plan_lanes(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lanes = joined.select(F.col("r_name").alias("lane"), F.concat_ws(" ", "n_name", "r_name").alias("q"), F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")).alias("k"))
    # the plan is capped for each provider: a top-k of a small dimension
    top = lanes.orderBy("k", "lane").limit(12)
    return top.select("lane", "q", F.row_number().over(Window.orderBy("k", "lane")).cast("long").alias("place"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'FAILED' WHEN c_acctbal < 1000 THEN 'DEGRADED' WHEN c_acctbal < 3000 THEN 'STALE' ELSE 'HEALTHY' END AS s, c_mktsegment FROM customer)
SELECT c_mktsegment, CASE max(CASE s WHEN 'FAILED' THEN 3 WHEN 'DEGRADED' THEN 2 WHEN 'STALE' THEN 1 ELSE 0 END) WHEN 3 THEN 'FAILED' WHEN 2 THEN 'DEGRADED' WHEN 1 THEN 'STALE' ELSE 'HEALTHY' END AS worst FROM r GROUP BY 1""")
def worst_status(spark, sf_dir):
    b = F.col("c_acctbal")
    rank = F.when(b < 0, 3).when(b < 1000, 2).when(b < 3000, 1).otherwise(0)
    names = F.array(*[F.lit(s) for s in ("HEALTHY", "STALE", "DEGRADED", "FAILED")])
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.element_at(names, F.max(rank) + 1).alias("worst"))


@query("""WITH e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), w AS (SELECT user_id, round(count(*) FILTER (WHERE k <= 7 AND bad) / count(*) FILTER (WHERE k <= 7), 4) AS r7, round(count(*) FILTER (WHERE k <= 14 AND bad) / count(*) FILTER (WHERE k <= 14), 4) AS r14 FROM e GROUP BY user_id)
SELECT user_id, r7, r14, round(abs(r7 - r14), 4) AS drift, CASE WHEN r7 > 0.4 OR r14 > 0.3 THEN 'BLOCKED' WHEN abs(r7 - r14) <= 0.2 THEN 'STABLE_FULL' ELSE 'OBSERVING' END AS state FROM w""")
def post_promotion_guard(spark, sf_dir):
    rates = streaks.recent_rates(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error", (7, 14))
    r7, r14 = F.col("rate_7"), F.col("rate_14")
    state = F.when((r7 > 0.4) | (r14 > 0.3), "BLOCKED").when(F.abs(r7 - r14) <= 0.2, "STABLE_FULL").otherwise("OBSERVING")
    return rates.select("user_id", r7.alias("r7"), r14.alias("r14"), F.round(F.abs(r7 - r14), 4).alias("drift"), state.alias("state"))
