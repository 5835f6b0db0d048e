"""Validation over the given tables: orders stand for what was held, their lines for what was detected."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation
from .registry import query, table

_ROWS = """g AS (SELECT o_orderkey AS gt_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 29 = 0 THEN 'CANCELLED' ELSE 'HELD' END AS actual, o_custkey AS fee, o_orderpriority AS venue FROM orders),
f AS (SELECT l_orderkey AS gt_id, day, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 29 = 0 THEN 'CANCELLED' ELSE 'VERIFIED' END ELSE 'POSSIBLE' END AS said, CASE WHEN l_quantity < 3 THEN fee + 1 ELSE fee END AS fee, CASE WHEN l_quantity > 49 THEN ' ' || upper(venue) ELSE venue END AS venue, l_discount > 0.09 AS touched, l_tax > 0.079 AND l_quantity > 48 AS made_up, FALSE AS cancel_miss FROM lineitem JOIN g ON gt_id = l_orderkey WHERE l_returnflag <> 'A'),
j AS (SELECT g.*, said, said = 'VERIFIED' AS v, f.fee = g.fee AS ok_fee, lower(trim(f.venue)) = lower(trim(g.venue)) AS ok_venue, touched, made_up FROM g LEFT JOIN f USING (gt_id, day)),
t AS (SELECT day, gt_id, CASE WHEN count(said) > 0 THEN 1 ELSE 0 END AS detected, count(*) FILTER (WHERE v) AS verified, count(*) FILTER (WHERE v AND ok_fee AND ok_venue AND actual = 'HELD') AS correct, count(*) FILTER (WHERE v AND ok_fee) AS fee, count(*) FILTER (WHERE v AND ok_venue) AS venue, count(*) FILTER (WHERE touched) AS touches, count(*) FILTER (WHERE made_up) AS hallucinated, CASE WHEN max(actual) = 'CANCELLED' AND count(*) FILTER (WHERE said = 'CANCELLED') = 0 THEN 1 ELSE 0 END AS misses FROM j GROUP BY 1, 2),
d AS (SELECT day, count(*) AS truths, sum(detected) AS detected, sum(verified) AS verified, sum(correct) AS correct, sum(fee) AS fee, sum(venue) AS venue, sum(touches) AS touches, sum(hallucinated) AS hallucinated, sum(misses) AS misses FROM t GROUP BY 1)"""


def _days(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    truth = table(spark, sf_dir, "orders").select(k.alias("gt_id"), day.alias("day"), F.when(k % 29 == 0, "CANCELLED").otherwise("HELD").alias("status"), day.alias("g_date"), F.lit("20:00").alias("g_time"), F.col("o_custkey").alias("g_fee"), F.col("o_orderpriority").alias("g_venue"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'").join(truth.drop("status"), F.col("gt_id") == F.col("l_orderkey"))
    said = F.when(F.col("l_linenumber") == 1, F.when(F.col("l_orderkey") % 29 == 0, "CANCELLED").otherwise("VERIFIED")).otherwise("POSSIBLE")
    found = lines.select(
        "gt_id", "day", said.alias("status"), F.col("g_date").alias("f_date"), F.col("g_time").alias("f_time"), F.when(F.col("l_quantity") < 3, F.col("g_fee") + 1).otherwise(F.col("g_fee")).alias("f_fee"),
        F.when(F.col("l_quantity") > 49, F.concat(F.lit(" "), F.upper("g_venue"))).otherwise(F.col("g_venue")).alias("f_venue"), (F.col("l_discount") > 0.09).alias("touched"), ((F.col("l_tax") > 0.079) & (F.col("l_quantity") > 48)).alias("hallucinated"), F.lit(False).alias("cancel_miss"),
    )
    return validation.compared(truth, found)


@query(f"WITH {_ROWS} SELECT day, CAST(truths AS BIGINT) AS truths, CAST(detected AS BIGINT) AS detected, CAST(verified AS BIGINT) AS verified, CAST(correct AS BIGINT) AS correct, CAST(fee AS BIGINT) AS fee, CAST(venue AS BIGINT) AS venue, CAST(touches AS BIGINT) AS touches, CAST(hallucinated AS BIGINT) AS hallucinated, CAST(misses AS BIGINT) AS misses, CAST(verified - correct AS BIGINT) AS false_verified FROM d")
def validation_days(spark, sf_dir):
    return _days(spark, sf_dir).drop("date", "time")


@query(f"""WITH {_ROWS}, s AS (SELECT sum(truths) AS truths, sum(detected) AS detected, sum(verified) AS verified, sum(correct) AS correct, sum(fee) AS fee, sum(venue) AS venue, sum(touches) AS touches, sum(hallucinated) AS hallucinated, sum(misses) AS misses FROM d)
SELECT round(detected / truths, 4) AS recall, round(correct / verified, 4) AS precision, 1.0::DOUBLE AS date_accuracy, 1.0::DOUBLE AS time_accuracy, round(fee / verified, 4) AS fee_accuracy, round(venue / verified, 4) AS venue_accuracy, round(touches / detected, 4) AS human_touch, CAST(verified - correct AS BIGINT) AS false_verified, CAST(hallucinated AS BIGINT) AS hallucinated, CAST(misses AS BIGINT) AS misses,
CASE WHEN verified > correct OR hallucinated > 0 OR misses > 0 THEN 'FAIL' WHEN detected / truths >= 0.85 AND touches / detected <= 0.2 THEN 'PASS' WHEN detected / truths >= 0.8 AND touches / detected <= 0.25 THEN 'CONDITIONAL_PASS' ELSE 'FAIL' END AS gate FROM s""")
def validation_gate(spark, sf_dir):
    return validation.judged(_days(spark, sf_dir))
