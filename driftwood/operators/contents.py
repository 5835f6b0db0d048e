"""The store of fetched articles: outcomes, retries, re-reading, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a fetch.
FULL, PARTIAL, BLOCKED = "FETCHED_FULL", "FETCHED_PARTIAL", "FETCH_BLOCKED"
FETCHED = (FULL, PARTIAL)
RETRIED = ("NOT_FETCHED", "FETCH_FAILED", BLOCKED)
PERMANENT = ("ROBOTS_DISALLOWED", "NOT_FOUND", "LOGIN_REQUIRED")
MOST_ATTEMPTS = 3


def queue_state(status: Column, error_code: Column, attempts: Column, next_at: Column) -> Column:
    """PENDING (never asked), RETRYABLE (asked, comes back) or TERMINAL (settled, refused for good, or given up)."""
    ends = F.coalesce(~status.isin(*RETRIED), F.lit(True)) | F.coalesce(error_code.isin(*PERMANENT), F.lit(False))
    return F.when(ends, "TERMINAL").when(next_at.isNotNull(), "RETRYABLE").when(F.coalesce(attempts, F.lit(0)) == 0, "PENDING").otherwise("TERMINAL")


def due(rows: DataFrame, key: str, now: Column, most: int) -> DataFrame:
    """The next ``most`` keys to ask: PENDING or past their next time, never-asked ones first."""
    state = queue_state(F.col("status"), F.col("error_code"), F.col("attempts"), F.col("next_at"))
    ready = rows.filter((state == "PENDING") | ((state == "RETRYABLE") & (F.col("next_at") <= now)))
    return ready.orderBy(F.asc_nulls_first("next_at"), key).limit(most).select(key, "next_at")


def reread_reasons(version: str) -> Column:
    """array of the reasons for which a stored row should be read again; empty for none.

    Its body came after the last reading, a blocked one gained a poster since,
    or another version of the reader read it.
    """
    status, since = F.col("status"), F.col("reread_at")
    readable = (status.isin(*FETCHED) & F.col("has_text")) | ((status == BLOCKED) & (F.col("posters") > 0))
    return F.array_compact(
        F.array(
            F.when(status.isin(*FETCHED) & F.col("has_text") & (since.isNull() | (since < F.col("fetched_at"))), "BODY_ARRIVED"),
            F.when((status == BLOCKED) & (F.col("posters") > 0) & (since.isNull() | (since < F.col("updated_at"))), "POSTER_GAINED"),
            F.when(readable & ~F.col("read_by").eqNullSafe(F.lit(version)), "VERSION_CHANGED"),
        )
    )


def to_reread(rows: DataFrame, version: str, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """item_id, reasons of rows to be read again; a row that failed too often is left out."""
    return rows.withColumn("reasons", reread_reasons(version)).filter((F.size("reasons") > 0) & (F.col("reread_attempts") < most_attempts)).select("item_id", F.array_join("reasons", ",").alias("reasons"))


def backlog(rows: DataFrame, version: str, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """One row: how many rows wait for each reason, and how many were given up."""
    marked = rows.withColumn("reasons", reread_reasons(version))
    waits = F.col("reread_attempts") < most_attempts
    has = lambda r: F.count_if(waits & F.array_contains("reasons", r))
    any_ = F.size("reasons") > 0
    return marked.agg(F.count_if(any_ & waits).alias("waiting"), has("BODY_ARRIVED").alias("body_arrived"), has("POSTER_GAINED").alias("poster_gained"), has("VERSION_CHANGED").alias("version_changed"), F.count_if(any_ & ~waits).alias("given_up"))


def freshness(version: str, most_attempts: int = MOST_ATTEMPTS) -> Column:
    """The state of a row's extraction, by the first rule that holds.

    Unreadable; stale (pending or failed for good); applied; kept as it was,
    by the policy or a person; and, where no outcome was recorded, what the
    row itself still tells.
    """
    stale = ~F.col("read_by").eqNullSafe(F.lit(version)) | F.col("revised_since")
    outcome, blocked = F.col("outcome"), F.col("status") == BLOCKED
    return (
        F.when(~F.col("readable"), "NOT_EXTRACTED")
        .when(stale & (F.col("reread_attempts") >= most_attempts), "REEXTRACTION_FAILED")
        .when(stale, "REEXTRACTION_PENDING")
        .when(outcome == "EXTRACTED", "CURRENT")
        .when(outcome.startswith("PRESERVED"), "UPDATE_NOT_APPLIED")
        .when((outcome == "KEPT_REVIEWED") | F.col("reviewed"), "HUMAN_DECISION_KEPT")
        .when(~blocked, "CURRENT")
        .when(F.col("body_lost"), "UPDATE_NOT_APPLIED")
        .when(F.coalesce("from_image", F.lit(True)) | F.col("body_lost").isNull(), "NOT_VERIFIED")
        .otherwise("CURRENT")
    )


def refresh_verdict(status: Column, method: Column, digest: Column, stored_method: Column, stored_digest: Column, http: Column, error_code: Column) -> Column:
    """What a new answer says about a stored article."""
    return (
        F.when(status == "NOT_MODIFIED", "NOT_MODIFIED")
        .when(status.isin(*FETCHED), F.when(~method.eqNullSafe(stored_method), "ADAPTER_MISMATCH").when(digest.eqNullSafe(stored_digest), "UNCHANGED").otherwise("REVISED"))
        .when(error_code == "ROBOTS_DISALLOWED", "ROBOTS_DISALLOWED")
        .when((status == "LOGIN_REQUIRED") | http.isin(401, 403), "FORBIDDEN")
        .when(http == 429, "RATE_LIMITED")
        .when(http.isin(404, 410), "NOT_FOUND")
        .when((status == BLOCKED) & ~error_code.isin("BODY_UNAVAILABLE", "BLOCKED", "NOT_FOUND"), "REFUSED")
        .when(error_code == "BODY_UNAVAILABLE", "BODY_UNAVAILABLE")
        .otherwise("FAILED")
    )


def lost_bodies(items: DataFrame, log: DataFrame, share: float = 0.5) -> DataFrame:
    """item_id, stored, best of items whose stored text (length) is under ``share`` of the best ever fetched (log: item_id, outcome, length)."""
    best = log.filter(F.col("outcome").isin(*FETCHED)).groupBy("item_id").agg(F.max("length").alias("best"))
    return items.join(best, "item_id").filter(F.coalesce("length", F.lit(0)) < F.col("best") * share).select("item_id", F.col("length").alias("stored"), "best")


def fetch_stats(log: DataFrame) -> DataFrame:
    """day, host, asked, fetched, chars, mean_ms of a fetch log (at, host, outcome, length, ms)."""
    fetched = F.col("outcome").startswith("FETCHED")
    return log.groupBy(F.to_date("at").alias("day"), "host").agg(F.count("*").alias("asked"), F.count_if(fetched).alias("fetched"), F.sum(F.when(fetched, F.col("length")).otherwise(0)).alias("chars"), F.round(F.avg("ms"), 2).alias("mean_ms"))
