"""Streams over the events table, drained: compared with the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental
from .registry import query, table


def _stream(spark, sf_dir):
    return incremental.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")


# the last windows stay open: append gives a window once the watermark (two hours behind the latest event) passes its end
_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query(f"SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_usage(spark, sf_dir):
    return incremental.drained(incremental.usage(_stream(spark, sf_dir))).withColumn("volume", F.round("volume", 2))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def stream_first_seen(spark, sf_dir):
    kept = incremental.drained(incremental.first_seen(_stream(spark, sf_dir), ["event_id"]))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id, event_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS passed, ts FROM events)
SELECT user_id, CAST(count(*) FILTER (WHERE passed = 0) AS BIGINT) AS streak, arg_max(event_id, (ts, event_id)) AS last_event FROM p GROUP BY user_id""")
def stream_failure_streak(spark, sf_dir):
    found = incremental.drained(incremental.failure_streaks(_stream(spark, sf_dir)), "update")
    best = F.max_by(F.struct("streak", "last_event"), "batch")
    return found.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.streak", "b.last_event")


@query(f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_sessions(spark, sf_dir):
    return incremental.drained(incremental.sessions(_stream(spark, sf_dir)))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def batch_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
