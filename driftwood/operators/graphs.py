"""Graph operators on edge tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees.

    Where that is unset a local session (one machine) gets a temporary folder;
    on a cluster there is no folder to guess, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="driftwood-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str = "graph") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/driftwood/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (a, b), root being the smallest node reachable.

    Alternates large-star steps (every larger neighbour is linked to the least
    node seen) and small-star steps (every node to its least neighbour); each
    round is a stored table, and rounds grow with the logarithm of the longest
    chain.  The least neighbour is combined before the shuffle; a hub's edges
    meet its label in a join that adaptive execution splits.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    state = None
    while True:
        found = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(linked.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), name)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def lineage(links: DataFrame) -> DataFrame:
    """node, ancestor, depth (of the shortest way) for links (node, parent), up to the last ancestor.

    A round joins the farthest pairs found so far with all found, so reach
    doubles; rounds end when no pair is as far as they reach.  A node of a cycle
    is no ancestor of itself.  Links without a parent end a line.  Where nodes
    have one parent and lines have not met a cycle, a round's pairs are all new:
    they are stored beside the others, which are neither grouped nor written
    again.
    """
    parts = [stored(links.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).filter("ancestor is not null and node <> ancestor").distinct(), "lineage")]
    one_way = parts[0].groupBy("node").count().filter("count > 1").isEmpty()
    reach = 1
    while not parts[-1].filter(F.col("depth") == reach).isEmpty():
        found = reduce(DataFrame.unionAll, parts)
        far = parts[-1].filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"), "depth")
        on = found.select(F.col("node").alias("via"), "ancestor", F.col("depth").alias("more"))
        further = far.join(on, "via").select("node", "ancestor", (F.col("depth") + F.col("more")).alias("depth"))
        if one_way:
            further = stored(further, "lineage")
            one_way = further.filter("node = ancestor").isEmpty()
        if one_way:
            parts.append(further)
        else:
            parts = [stored(found.unionAll(further.filter("node <> ancestor")).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "lineage")]
        reach *= 2
    return reduce(DataFrame.unionAll, parts)
