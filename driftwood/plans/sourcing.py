"""Cross-posts, their origins, and independence of sources.

Documents stand for posts: the first two words name the event, the first line
is the title, the last of several lines stands for the poster.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import similarity
from ..operators import origins
from .registry import query, table


def posts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    last = F.element_at(lines, -1)
    return docs.select(
        F.regexp_extract(F.lower("text"), r"^\S+\s+\S+", 0).alias("event"),
        "source",
        F.col("doc_id").alias("post_id"),
        lines[0].alias("title"),
        F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ").alias("body"),
        F.when(F.col("n_chars") % 10 > 0, F.timestamp_seconds(1704067200 + F.col("doc_id") * 61)).alias("published_at"),
        F.concat(F.lit("https://"), "lang", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.size(lines) > 1, F.concat(F.lit("http://img.example/"), F.md5(last))).alias("poster"),
        F.when(F.col("n_chars") % 50 == 0, "src0").alias("origin"),
    )


def relationships(spark, sf_dir):
    k = F.col("n_nationkey")
    kind = F.when(F.col("n_regionkey") < 3, "INDEPENDENT").when(F.col("n_regionkey") == 3, "RELATED").otherwise("UNKNOWN")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (k % 20).cast("string")).alias("a"), F.concat(F.lit("src"), ((k * 7 + 3) % 20).cast("string")).alias("b"), kind.alias("relationship"), k.alias("at")).filter("a <> b")


def reviews(members):
    """Clusters of three and more were looked at."""
    decision = F.when(F.col("member_count") % 3 == 0, "CONFIRM_SYNDICATION").when(F.col("member_count") % 3 == 1, "CONFIRM_INDEPENDENT").otherwise("HOLD")
    return members.filter("is_origin and member_count > 2").select("event", "cluster", decision.alias("decision"), F.lit(1).alias("reviewed_at"))


def _members(spark, sf_dir):
    found = origins.cross_posts(posts(spark, sf_dir), similarity)
    return origins.with_status(found, reviews(found))


@query(None)
def cross_post_clusters(spark, sf_dir):
    return _members(spark, sf_dir).withColumn("text_similarity", F.round("text_similarity", 6)).withColumn("origin_score", F.round("origin_score", 6))


def _verdicts(spark, sf_dir):
    found, all_posts, stated = _members(spark, sf_dir), posts(spark, sf_dir), relationships(spark, sf_dir)
    return origins.pair_verdicts(origins.stated_pairs(all_posts, stated, found), all_posts, stated, found)


@query(None)
def pair_independence(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(None)
def independent_sources(spark, sf_dir):
    return origins.independent_sources(_verdicts(spark, sf_dir))
