"""Incremental operators: intake, digests, upserts, retries.

State is a table; each operator compares it with what came and says what to do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def digest(*columns: Column | str) -> Column:
    """sha256 over the columns, null told from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def intake(stored: DataFrame, incoming: DataFrame, key: str, hash_: str) -> DataFrame:
    """``incoming`` with outcome NEW, REVISED or DUPLICATE against ``stored`` (key, hash).

    Of rows that repeat a key in one batch the first by hash counts and the
    others are DUPLICATE.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(hash_))
    known = stored.select(F.col(key), F.col(hash_).alias("_known")).dropDuplicates([key])
    joined = incoming.withColumn("_nth", nth).join(known, key, "left")
    outcome = F.when(F.col("_nth") > 1, "DUPLICATE").when(F.col("_known").isNull(), "NEW").when(F.col("_known") != F.col(hash_), "REVISED").otherwise("DUPLICATE")
    return joined.withColumn("outcome", outcome).drop("_nth", "_known")


def upserted(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``stored`` with the incoming rows put over it; a null incoming value keeps the stored one."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return stored.join(new, list(keys), "full_outer").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def stale(items: DataFrame, state: DataFrame, key: str, digest_: str, version: str, retries: int) -> DataFrame:
    """key, reason of the items to work on again.

    ``state`` has key, digest, version, status, attempts: NEVER_DONE,
    INPUT_CHANGED, VERSION_CHANGED, RETRY (failed fewer than ``retries``
    times); what is done and unchanged, or failed too often, is left out.
    """
    seen = state.select(F.col(key), F.col(digest_).alias("_digest"), F.col("version").alias("_version"), "status", "attempts")
    joined = items.join(seen, key, "left")
    reason = (
        F.when(F.col("_digest").isNull(), "NEVER_DONE")
        .when(~F.col("_digest").eqNullSafe(F.col(digest_)), "INPUT_CHANGED")
        .when(F.col("_version") != version, "VERSION_CHANGED")
        .when((F.col("status") == "FAILED") & (F.col("attempts") < retries), "RETRY")
    )
    return joined.withColumn("reason", reason).filter("reason is not null").select(key, "reason")


def synced(current: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, action: INSERT what is wanted and missing, DELETE what is there and unwanted; a null key is one like any other.

    One grouping tells on which sides a key is (1: there, 2: wanted), so sides are neither joined nor sorted.
    """
    both = current.select(*keys, F.lit(1).alias("_side")).unionByName(wanted.select(*keys, F.lit(2).alias("_side")))
    sides = both.groupBy(*keys).agg(F.bit_or("_side").alias("_sides")).filter("_sides <> 3")
    return sides.select(*keys, F.when(F.col("_sides") == 2, "INSERT").otherwise("DELETE").alias("action"))


def accumulated(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Daily counters: what is stored plus what came, by keys."""
    both = stored.select(*keys, *counters).unionByName(incoming.select(*keys, *counters))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def retry_at(attempts: Column, last: Column, base_minutes: int = 10, most_minutes: int = 1440) -> Column:
    """When to try again: the wait doubles with every attempt up to a most; jitter is the caller's."""
    minutes = F.least(F.lit(float(most_minutes)), F.lit(float(base_minutes)) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    return F.timestamp_seconds(F.unix_seconds(last.cast("timestamp")) + (minutes * 60).cast("long"))


def matched_identities(old: DataFrame, new: DataFrame, id_: str, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """old_id, new_id, tier: tiers of keys in turn; a tier matches keys that one old and one new row have, among rows not matched yet.

    Keys with a null part match nothing, and n:m keys are left to later tiers.
    """
    found = None
    for level, keys in enumerate(tiers, 1):
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        sides = []
        for rows, name in ((old, "old_id"), (new, "new_id")):
            left = rows if found is None else rows.join(found.select(F.col(name).alias(id_)), id_, "left_anti")
            sides.append(left.filter(known).groupBy(*keys).agg(F.count("*").alias(f"_{name}"), F.min(id_).alias(name)).filter(F.col(f"_{name}") == 1))
        hits = sides[0].join(sides[1], list(keys)).select("old_id", "new_id", F.lit(level).cast("long").alias("tier"))
        found = hits if found is None else found.unionAll(hits)
    return found
