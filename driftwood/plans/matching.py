"""Labels in context, snapshots of days, and recovery of events from other sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import similarity
from ..operators import contexts, recovery, snapshots
from ..operators.graphs import shared_folder
from .registry import query, table
from .shapes import events

#: Words by which a text seems to be of a language, words close by that speak against it, and words that speak for any.
WORDS = [
    *(("en", contexts.WORD, k, w) for k, w in enumerate(("the ", "and ", "tion"))),
    *(("en", contexts.NEGATIVE, k, w) for k, w in enumerate((" de ", "eau", " und "))),
    *(("fr", contexts.WORD, k, w) for k, w in enumerate((" des ", " les ", "tion"))),
    *(("fr", contexts.NEGATIVE, k, w) for k, w in enumerate((" the ", "wh", "ing"))),
    *(("de", contexts.WORD, k, w) for k, w in enumerate((" und ", "ich ", "sch"))),
    *(("de", contexts.NEGATIVE, k, w) for k, w in enumerate(("tion", "ñ"))),
    *(("any", contexts.CONTEXT, k, w) for k, w in enumerate(("license", "copyright", "@"))),
]


@query(None)
def labels_in_context(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    words = spark.createDataFrame(WORDS, "label string, role string, rank int, word string")
    return contexts.labels_in_context(texts, words).withColumnRenamed("key", "doc_id")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS was, CASE WHEN o_totalprice > 499000 THEN 'X' ELSE o_orderstatus END AS now FROM orders) SELECT k, was, now FROM o WHERE was <> now""")
def snapshot_changes(spark, sf_dir):
    """Orders that differ from a day's snapshot: only buckets whose digests differ are compared row by row."""
    kept = snapshots.Snapshots(spark, f"{shared_folder(spark).rstrip('/')}/driftwood/snapshots-{uuid.uuid4().hex}", ["o_orderkey"], 12)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept.write(orders, "2024-01-01")
    now = orders.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 499000, "X").otherwise(F.col("o_orderstatus")))
    buckets = kept.changed("2024-01-01", now).select("leaf")
    leaf = F.pmod(F.xxhash64("o_orderkey"), F.lit(1 << 12)).cast("int")
    there = lambda rows, name: rows.withColumn("leaf", leaf).join(buckets, "leaf", "left_semi").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias(name))
    return there(kept.rows("2024-01-01"), "was").join(there(now, "now"), "k").filter("was <> now")


def _sides(spark, sf_dir):
    """First-hand events that lack a clock look for a second-hand sighting of the same day and place."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), "event_date", F.lower("venue").alias("venue_key"), F.concat_ws(" ", "genre", "region").alias("name"), "start_min", F.round("fee", 2).alias("fee"), "tier")
    return e.filter("tier in ('PRIMARY', 'OFFICIAL')"), e.filter("tier = 'OTHER'")


@query(None)
def recovered_events(spark, sf_dir):
    wanted, found = _sides(spark, sf_dir)
    wanted = wanted.withColumn("fee", F.when(F.col("fee") > 250000, F.col("fee")))
    pairs = recovery.one_to_one_matches(wanted, found, similarity)
    return recovery.recovered(wanted, pairs, found, ["event_date", "start_min", "fee"], ["event_date", "start_min", "fee"])
