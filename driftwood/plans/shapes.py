"""The given tables in the shape that the operators read.

Orders stand for events: a period from the order's day to its last shipping
day, a clock derived from the key, nation and region for places, segment for
genre, priority for tier.  The SQL of ``EVENTS_SQL`` says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("last"))
    star = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    star = star.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    star = star.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    day = F.to_date("o_orderdate")
    tiers = F.when(F.col("o_orderpriority").startswith("1"), "PRIMARY").when(F.col("o_orderpriority").startswith("2"), "OFFICIAL").when(F.col("o_orderpriority").startswith("3"), "COMMUNITY").otherwise("OTHER")
    return star.select(
        F.col("o_orderkey").alias("event_id"),
        day.alias("event_date"),
        F.when(F.datediff("last", day).between(1, 31), F.col("last")).alias("end_date"),
        F.when(F.col("o_orderkey") % 5 != 0, ((F.col("o_orderkey") % 24) * 60).cast("int")).alias("start_min"),
        F.col("c_mktsegment").alias("genre"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("venue"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "POSSIBLE").otherwise("VERIFIED").alias("status"),
        tiers.alias("tier"),
        F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") - 1).alias("canonical_id"),
        F.col("o_custkey").alias("source_id"),
        F.col("o_totalprice").alias("fee"),
    )


EVENTS_SQL = """ev AS (
  SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date,
    CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), last) BETWEEN 1 AND 31 THEN last END AS end_date,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_orderkey % 24) * 60 AS INTEGER) END AS start_min,
    c_mktsegment AS genre, r_name AS region, n_name AS venue,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'POSSIBLE' ELSE 'VERIFIED' END AS status,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'PRIMARY' WHEN o_orderpriority LIKE '2%' THEN 'OFFICIAL' WHEN o_orderpriority LIKE '3%' THEN 'COMMUNITY' ELSE 'OTHER' END AS tier,
    CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 END AS canonical_id, o_custkey AS source_id, o_totalprice AS fee
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""

#: Orders with a returned line count as held by one more genre.
MORE_GENRES_SQL = "more AS (SELECT DISTINCT l_orderkey AS event_id, 'BUILDING' AS genre FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)"


def more_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 1")
    return lines.select(F.col("l_orderkey").alias("event_id"), F.lit("BUILDING").alias("genre")).distinct()
