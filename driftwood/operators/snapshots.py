"""Days of rows kept as they were: written once, with a tree of digests by which a changed part is found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaves of a day's tree are 2 ** LEVELS buckets of keys.
LEVELS = 8


def row_digest(columns: Sequence[str]):
    """SHA-256 of a row's columns as JSON; nulls are said, so a missing value is no empty one."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def leaves(rows: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """leaf, n, digest: the rows of each bucket of keys as a multiset, in no order.

    Parts of the rows' digests are added up, so a bucket of any size is summed
    before it is shuffled.
    """
    columns = sorted(rows.columns)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << levels)).cast("int")
    part = lambda k: F.sum(F.conv(F.substr("_digest", F.lit(1 + 12 * k), F.lit(12)), 16, 10).cast("decimal(38,0)"))
    sums = rows.select(bucket.alias("leaf"), row_digest(columns).alias("_digest")).groupBy("leaf").agg(F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(5)])
    return sums.select("leaf", "n", F.sha2(F.concat_ws(":", "n", *[f"s{k}" for k in range(5)]), 256).alias("digest"))


def tree(leaf_digests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """level, node, digest: leaves at ``levels``, the root at 0; a node is the digest of its two children (an empty bucket's is empty)."""
    level = leaf_digests.select(F.col("leaf").alias("node"), "digest")
    out = level.select(F.lit(levels).alias("level"), "node", "digest")
    for k in range(levels - 1, -1, -1):
        sides = [F.coalesce(F.max(F.when(F.col("node") % 2 == side, F.col("digest"))), F.lit("")) for side in (0, 1)]
        level = level.groupBy(F.floor(F.col("node") / 2).cast("int").alias("parent")).agg(F.sha2(F.concat_ws("|", *sides), 256).alias("digest")).withColumnRenamed("parent", "node")
        out = out.unionAll(level.select(F.lit(k).alias("level"), "node", "digest"))
    return out


class Snapshots:
    """Daily snapshots in a folder that executors share."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], levels: int = LEVELS) -> None:
        self.spark, self.folder, self.keys, self.levels = spark, folder.rstrip("/"), list(keys), levels

    def write(self, rows: DataFrame, day: str) -> bool:
        """Keeps a day's rows and their tree; False, and nothing is written, if the day was kept before.

        The tree is written last: a day that broke off has none, and is written anew.
        """
        if self._is_kept(day):
            return False
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/day={day}")
        kept = self.rows(day)
        tree(leaves(kept, self.keys, self.levels), self.levels).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/trees/day={day}")
        return True

    def _is_kept(self, day: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/trees/day={day}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self, day: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows/day={day}")

    def kept_tree(self, day: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/trees/day={day}")

    def verify(self, day: str) -> DataFrame:
        """leaf, kept, now: buckets of the day whose rows are no longer those that were written; none if all are."""
        now = leaves(self.rows(day), self.keys, self.levels).select("leaf", F.col("digest").alias("now"))
        return self._differing(self.kept_tree(day), now)

    def changed(self, day: str, other: DataFrame) -> DataFrame:
        """leaf, kept, now: buckets in which the day and ``other`` rows differ."""
        now = leaves(other.select(self.rows(day).columns), self.keys, self.levels).select("leaf", F.col("digest").alias("now"))
        return self._differing(self.kept_tree(day), now)

    def _differing(self, kept: DataFrame, now: DataFrame) -> DataFrame:
        was = kept.filter(F.col("level") == self.levels).select(F.col("node").alias("leaf"), F.col("digest").alias("kept"))
        return was.join(now, "leaf", "full").filter(~F.col("kept").eqNullSafe(F.col("now"))).select("leaf", "kept", "now")
