"""Pairs of events over the given tables: events of one day and country, told by several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import pairs
from .registry import query, table
from .shapes import EVENTS_SQL, events

_TODAY = "1998-06-03"
_WORDS = ", ".join(f"'{w}'" for w in pairs.GENERIC)
_MEMBERS = f"""n AS (SELECT event_id, event_date, venue, source_id, end_date, genre = 'BUILDING' AS festival, CASE WHEN event_id % 3 <> 0 THEN venue END AS venue_id, CASE WHEN event_id % 4 <> 0 THEN CAST((event_id % 3) * 45 + 1200 AS INTEGER) END AS start_min,
CASE event_id % 4 WHEN 0 THEN 'Milonga ' || genre WHEN 1 THEN genre || ' night ' || tier WHEN 2 THEN 'Social: ' || tier || genre ELSE 'Milonga' END AS name FROM ev),
m AS (SELECT *, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: w NOT IN ({_WORDS})) AS words FROM n)"""
_PAIRED = """p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, a, b, a.event_date AS event_date, array_to_string(a.words, '') AS wa, array_to_string(b.words, '') AS wb, len(a.words) > 0 AND len(b.words) > 0 AS named, COALESCE(a.start_min = b.start_min, FALSE) AS clock, COALESCE(a.venue_id = b.venue_id, FALSE) AS place FROM m a JOIN m b ON a.event_date = b.event_date AND a.venue = b.venue AND a.event_id < b.event_id),
q AS (SELECT *, named AND (list_has_all(a.words, b.words) OR list_has_all(b.words, a.words) OR CASE WHEN length(wa) <= length(wb) THEN contains(wb, wa) AND len(list_filter(a.words, lambda w: NOT contains(wb, w))) = 0 ELSE contains(wa, wb) AND len(list_filter(b.words, lambda w: NOT contains(wa, w))) = 0 END) AS names,
a.venue_id IS NOT NULL AND b.venue_id IS NOT NULL AND a.venue_id <> b.venue_id AS conflict, a.source_id <> b.source_id AS independent, a.end_date IS NOT NULL AND b.end_date IS NOT NULL AND a.end_date <> b.end_date AS ends_differ, COALESCE(abs(a.start_min - b.start_min) <= 60, TRUE) AS close FROM p),
r AS (SELECT *, CASE WHEN place AND clock THEN 'RULES' WHEN conflict THEN NULL WHEN names AND clock THEN 'NAME_AND_START' WHEN a.festival AND b.festival AND names AND independent AND NOT ends_differ THEN 'FESTIVAL_OF_TWO_SOURCES' WHEN names AND place AND independent AND close THEN 'NAME_AND_PLACE_OF_TWO_SOURCES' END AS why FROM q)"""


def _members(spark, sf_dir):
    k, genre, tier = F.col("event_id"), F.col("genre"), F.col("tier")
    name = F.when(k % 4 == 0, F.concat(F.lit("Milonga "), genre)).when(k % 4 == 1, F.concat(genre, F.lit(" night "), tier)).when(k % 4 == 2, F.concat(F.lit("Social: "), tier, genre)).otherwise("Milonga")
    found = events(spark, sf_dir)
    return found.select("event_id", "event_date", "venue", "source_id", "end_date", (genre == "BUILDING").alias("festival"), F.when(k % 3 != 0, F.col("venue")).alias("venue_id"), F.when(k % 4 != 0, (k % 3 * 45 + 1200).cast("int")).alias("start_min"), pairs.name_words(name).alias("words"))


def _paired(spark, sf_dir):
    joined = pairs.met(_members(spark, sf_dir), ["event_date", "venue"])
    return joined.select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), "event_date", F.col("a.end_date").alias("a_end"), "a", "b", "names")


@query(f"""WITH {EVENTS_SQL}, {_MEMBERS}, {_PAIRED} SELECT a_id, b_id, why IS NOT NULL AS ready, why, CASE WHEN why IS NOT NULL THEN CASE WHEN independent OR (names AND clock AND place) THEN 'STRONG' ELSE 'MODERATE' END WHEN names OR clock OR place THEN 'WEAK' ELSE 'NONE' END AS strength,
concat_ws(',', CASE WHEN names THEN 'NAME' END, CASE WHEN clock THEN 'START' END, CASE WHEN place THEN 'PLACE' END, CASE WHEN independent THEN 'INDEPENDENT' END) AS facts FROM r""")
def merge_readiness(spark, sf_dir):
    return pairs.readiness(_paired(spark, sf_dir)).select("a_id", "b_id", "ready", "why", "strength", "facts")


@query(f"""WITH {EVENTS_SQL}, {_MEMBERS}, {_PAIRED}, s AS (SELECT *, CASE WHEN a_id % 5 = 0 THEN b_id % 50 END AS a_root, CASE WHEN b_id % 7 = 0 THEN a_id END AS b_root, b_id % 2 = 0 AS person_fold FROM r),
t AS (SELECT *, CASE WHEN a_id % 19 = 0 THEN 'PERSON' WHEN b_id % 23 = 0 THEN 'INVALID' WHEN (a_root IS NOT NULL OR b_root IS NOT NULL) AND COALESCE(a_root, a_id) = COALESCE(b_root, b_id) AND NOT person_fold THEN 'RULES' WHEN a_root IS NOT NULL OR b_root IS NOT NULL THEN 'SUPERSEDED' WHEN NOT (clock OR names) OR why = 'RULES' THEN 'STALE' WHEN why IS NOT NULL THEN 'ACTIONABLE' ELSE 'BLOCKED' END AS status,
CASE WHEN event_date > DATE '{_TODAY}' THEN 'UPCOMING' WHEN COALESCE(a.end_date, event_date) >= DATE '{_TODAY}' THEN 'ONGOING' ELSE 'PAST' END AS timing FROM s)
SELECT a_id, b_id, status, CASE WHEN status = 'ACTIONABLE' THEN CASE timing WHEN 'ONGOING' THEN 0 WHEN 'UPCOMING' THEN 1 ELSE 4 END WHEN status IN ('STALE', 'BLOCKED') THEN CASE WHEN timing = 'PAST' THEN 5 ELSE 3 END ELSE 6 END AS priority FROM t""")
def pair_statuses(spark, sf_dir):
    found = pairs.readiness(_paired(spark, sf_dir))
    a, b = F.col("a_id"), F.col("b_id")
    asked = found.withColumns({
        "decided_by": F.when(a % 19 == 0, "PERSON"), "missing": b % 23 == 0, "a_root": F.when(a % 5 == 0, b % 50), "b_root": F.when(b % 7 == 0, a), "person_fold": b % 2 == 0,
        "rule": F.when(F.col("paired"), "SAME_DAY"), "open": F.col("ready"),
    })
    timing = labels.timing(F.col("event_date"), F.col("a_end"), F.lit(False), F.lit(_TODAY).cast("date"))
    return pairs.pair_status(asked).select("a_id", "b_id", "status", pairs.queue_priority(F.col("status"), timing).cast("int").alias("priority"))


@query(f"""WITH {EVENTS_SQL} SELECT a.event_id, a.canonical_id, CASE WHEN a.status = 'POSSIBLE' THEN 'HIDDEN' ELSE 'LISTED' END AS listing FROM ev a JOIN ev b ON b.event_id = a.canonical_id
WHERE a.source_id % 10 <> 0 AND NOT COALESCE(a.event_date = b.event_date AND a.venue = b.venue AND a.start_min = b.start_min, FALSE) AND NOT COALESCE(a.genre = b.genre AND a.region = b.region, FALSE)""")
def stale_releases(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("decided_by", F.when(F.col("source_id") % 10 == 0, "PERSON").otherwise("AUTO")).withColumn("review", F.when(F.col("status") == "POSSIBLE", "rejected"))
    same = lambda *names: F.coalesce(F.lit(True) & (F.col(f"a.{names[0]}") == F.col(f"b.{names[0]}")) & F.forall(F.array(*[F.col(f"a.{n}") == F.col(f"b.{n}") for n in names[1:]]), lambda x: x), F.lit(False))
    return pairs.stale_folds(rows, same("event_date", "venue", "start_min") | same("genre", "region"))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT event_id, CASE WHEN event_id % 501 = 0 THEN event_id ELSE canonical_id END AS canonical_id, CASE WHEN event_id % 22 = 0 THEN 'HIDDEN' ELSE 'LISTED' END AS listing FROM ev), j AS (SELECT e.*, r.event_id AS root, r.canonical_id AS above FROM e LEFT JOIN e r ON r.event_id = e.canonical_id)
SELECT 'SELF_FOLD' AS gate, CAST(count(*) FILTER (WHERE canonical_id = event_id) AS BIGINT) AS n FROM j UNION ALL SELECT 'ROOT_GONE', count(*) FILTER (WHERE canonical_id IS NOT NULL AND root IS NULL) FROM j UNION ALL SELECT 'CHAINED', count(*) FILTER (WHERE canonical_id IS NOT NULL AND above IS NOT NULL) FROM j UNION ALL SELECT 'FOLDED_BUT_LISTED', count(*) FILTER (WHERE canonical_id IS NOT NULL AND listing = 'LISTED') FROM j""")
def fold_integrity(spark, sf_dir):
    k = F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", F.when(k % 501 == 0, k).otherwise(F.col("canonical_id")).alias("canonical_id"), F.when(k % 22 == 0, "HIDDEN").otherwise("LISTED").alias("listing"))
    return pairs.integrity(rows)
