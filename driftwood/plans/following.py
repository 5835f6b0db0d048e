"""Late bodies, isolated batches, revisions and limits over the given tables, followed as streams."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import incremental as identities
from ..streaming import incremental, late, ledger, lifecycle
from .registry import query, table


def _read_lines(texts):
    """Each line is a candidate: its first word the key, its second the title."""
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    word = lambda line, k: F.get(F.split(line, " "), F.lit(k))
    made = F.transform(lines, lambda line: F.struct(word(line, 0).alias("key"), word(line, 1).alias("title"), line.alias("detail")))
    return texts.select("digest", made.alias("candidates"))


def _late(spark, sf_dir):
    """A conversation's turns stand for versions of one item: users' turns for blocked fetches, some for a person's review."""
    rows = incremental.file_stream(spark, f"{sf_dir.rstrip('/')}/conversations.parquet").filter("conv_id is not null and turn is not null")
    kind = F.when(F.length("text") % 11 == 0, "REVIEW").otherwise("BODY")
    shaped = rows.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("at"), kind.alias("kind"), F.when(F.col("role") == "user", "BLOCKED").otherwise("FULL").alias("status"), "text")
    return late.LateReadings(spark, _read_lines).follow(shaped)


_VERSIONS = """v AS (SELECT DISTINCT conv_id AS item_id, turn AS moment, CASE WHEN length(text) % 11 = 0 THEN 'REVIEW' ELSE 'BODY' END AS kind, CASE WHEN role = 'user' THEN 'BLOCKED' ELSE 'FULL' END AS status, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, COALESCE(bool_or(kind = 'REVIEW') OVER w, FALSE) AS reviewed, COALESCE(max(CASE WHEN kind = 'BODY' AND status = 'FULL' THEN length(text) END) OVER w, 0) AS best, row_number() OVER (PARTITION BY item_id ORDER BY moment, kind, sha256(text), status) AS nth FROM v WINDOW w AS (PARTITION BY item_id ORDER BY moment, kind, sha256(text), status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, kind = 'BODY' AND NOT reviewed AND NOT (status = 'BLOCKED' AND length(text) < best) AS applied FROM o)"""


@query(f"WITH {_VERSIONS}, l AS (SELECT item_id, arg_max(text, nth) AS text FROM a WHERE applied GROUP BY item_id) SELECT item_id, detail FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS detail FROM l) WHERE detail <> ''")
def late_bodies(spark, sf_dir):
    return _late(spark, sf_dir).candidates().select("item_id", "detail")


@query(f"""WITH {_VERSIONS}, s AS (SELECT *, max(CASE WHEN applied THEN nth END) OVER (PARTITION BY item_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a), c AS (SELECT s.*, p.text AS held FROM s LEFT JOIN a p ON p.item_id = s.item_id AND p.nth = s.before)
SELECT CASE WHEN kind = 'REVIEW' THEN 'REVIEWED' WHEN text = held THEN 'UNCHANGED' WHEN reviewed THEN 'KEPT_HUMAN_REVIEWED' WHEN status = 'BLOCKED' AND length(text) < best THEN 'PRESERVED_BODY_LOST' ELSE 'EXTRACTED' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1""")
def late_outcomes(spark, sf_dir):
    return _late(spark, sf_dir).outcomes().groupBy("outcome").agg(F.count("*").alias("n"))


def _ratios():
    def step(batch: pd.DataFrame) -> pd.DataFrame:
        some = batch[batch["event_type"] != "click"]
        return pd.DataFrame({"event_id": some["event_id"], "ratio": [1000 // (json.loads(p)["k"] - 50) for p in some["props"]]}, index=some.index)

    return step


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN event_type = 'click' THEN 'SKIPPED' WHEN k = 50 THEN 'FAILED' ELSE 'NORMALIZED' END AS outcome,
CASE WHEN event_type <> 'click' AND k <> 50 THEN CAST(floor(1000.0 / (k - 50)) AS BIGINT) END AS ratio, CASE WHEN event_type <> 'click' AND k = 50 THEN 'ZeroDivisionError' END AS error FROM e""")
def isolated_normalization(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", identities.digest("event_type", "props").alias("digest"), "event_type", "props")
    made = ledger.Ledger(spark, "event_id", _ratios(), StructType([StructField("event_id", LongType()), StructField("ratio", LongType())]))
    made.take(made.stale(rows), 0)
    return made.current().select("event_id", "outcome", "ratio", F.substring_index("error", ":", 1).alias("error"))


_ROLE = "CASE event_type WHEN 'error' THEN 'CANCELLATION' WHEN 'purchase' THEN 'UPDATE' ELSE 'ORIGINAL' END"


@query(f"""WITH r AS (SELECT *, {_ROLE} AS role, row_number() OVER w AS nth, COALESCE(last_value(CASE event_type WHEN 'error' THEN 'CANCELLED' WHEN 'purchase' THEN 'UPDATED' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'ACTIVE') AS status_to,
COALESCE(last_value(CASE event_type WHEN 'error' THEN 'CANCELLED' WHEN 'purchase' THEN 'UPDATED' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ACTIVE') AS status_from FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS event_id, event_id AS revision_id, role, status_from, status_to, CAST(nth AS BIGINT) AS nth FROM r WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)""")
def stream_revisions(spark, sf_dir):
    role = F.when(F.col("event_type") == "error", "CANCELLATION").when(F.col("event_type") == "purchase", "UPDATE").otherwise("ORIGINAL")
    none = F.lit(None).cast("string")
    rows = incremental.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet").select(F.col("user_id").alias("event_id"), F.col("event_id").alias("revision_id"), "ts", role.alias("role"), none.alias("start_time"), none.alias("venue"))
    with incremental.keyed_state(spark):
        return incremental.drained(lifecycle.applied_revisions(rows)).select("event_id", "revision_id", "role", "status_from", "status_to", "nth")


@query(None)
def stream_limits(spark, sf_dir):
    rows = incremental.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet").select(F.col("user_id").alias("client"), F.col("event_id").alias("attempt_id"), "ts", F.col("event_type").alias("what"))
    limits = lifecycle.Limits(short=(2, 6 * 3600), long=(4, 24 * 3600), duplicate=12 * 3600)
    with incremental.keyed_state(spark):
        return incremental.drained(lifecycle.limited_attempts(rows, limits)).select("client", "attempt_id", "verdict", "wait")
