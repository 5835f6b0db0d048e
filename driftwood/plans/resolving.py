"""Intake, digests, identities, duplicates, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import folded_key, similarity
from ..operators import duplicates, graphs, incremental, previews, resolution
from .registry import query, table
from .shapes import EVENTS_SQL, events


@query("""WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN old.h IS NULL THEN 'NEW' WHEN old.h <> new.h THEN 'REVISED' ELSE 'DUPLICATE' END AS outcome FROM new LEFT JOIN old USING (doc_id)""")
def intake_outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = docs.filter("doc_id % 2 = 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return incremental.intake(old, new, "doc_id", "h").select("doc_id", "outcome")


@query("""WITH d AS (SELECT o_orderkey, sha256(concat_ws(chr(31), '=' || CAST(o_custkey AS VARCHAR), COALESCE('=' || o_orderstatus, ''), COALESCE('=' || o_orderpriority, ''))) AS digest FROM orders),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE digest END AS digest, CASE WHEN o_orderkey % 10 = 1 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN o_orderkey % 10 IN (2, 3) THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 5 END AS attempts FROM d WHERE o_orderkey % 10 <> 4)
SELECT d.o_orderkey, CASE WHEN s.digest IS NULL THEN 'NEVER_DONE' WHEN s.digest <> d.digest THEN 'INPUT_CHANGED' WHEN version <> 'v2' THEN 'VERSION_CHANGED' ELSE 'RETRY' END AS reason FROM d LEFT JOIN s USING (o_orderkey)
WHERE s.digest IS NULL OR s.digest <> d.digest OR version <> 'v2' OR (status = 'FAILED' AND attempts < 3)""")
def stale_selection(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", incremental.digest("o_custkey", "o_orderstatus", "o_orderpriority").alias("digest"))
    k = F.col("o_orderkey") % 10
    state = items.filter(k != 4).select("o_orderkey", F.when(k == 0, "x").otherwise(F.col("digest")).alias("digest"), F.when(k == 1, "v1").otherwise("v2").alias("version"), F.when(k.isin(2, 3), "FAILED").otherwise("DONE").alias("status"), F.when(k == 2, 1).otherwise(5).alias("attempts"))
    return incremental.stale(items, state, "o_orderkey", "digest", "v2", 3)


@query("""SELECT COALESCE(a.c_custkey, b.c_custkey) AS c_custkey, COALESCE(b.seg, a.seg) AS seg, COALESCE(b.bal, a.bal) AS bal FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' END AS seg, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""")
def upserted_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "MOVED").alias("seg"), (F.col("c_acctbal") + 1).alias("bal"))
    return incremental.upserted(old, new, ["c_custkey"], ["seg", "bal"])


@query("SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS requests, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2")
def accumulated_counters(spark, sf_dir):
    daily = lambda part: table(spark, sf_dir, "events").filter(f"event_id % 2 = {part}").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.sum("value").alias("volume"))
    return incremental.accumulated(daily(0), daily(1), ["event_type", "day"], ["requests", "volume"]).withColumn("volume", F.round("volume", 2))


@query("""WITH cur AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2), want AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber >= 2)
SELECT *, 'INSERT' AS action FROM (SELECT * FROM want EXCEPT SELECT * FROM cur) UNION ALL SELECT *, 'DELETE' AS action FROM (SELECT * FROM cur EXCEPT SELECT * FROM want)""")
def synced_bridge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_returnflag"]
    return incremental.synced(lines.filter("l_linenumber <= 2").select(keys), lines.filter("l_linenumber >= 2").select(keys), keys)


@query("SELECT event_id, ts + to_seconds(CAST(least(1440.0, 10.0 * pow(2.0, greatest(event_id % 12 - 1, 0))) * 60 AS BIGINT)) - to_microseconds(CAST(epoch_us(ts) % 1000000 AS BIGINT)) AS next_try FROM events WHERE event_type = 'error'")
def retry_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return rows.select("event_id", incremental.retry_at(F.col("event_id") % 12, F.col("ts")).alias("next_try"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p FROM orders), a AS (SELECT * FROM o WHERE id % 2 = 0), b AS (SELECT id, c, CASE WHEN id % 3 = 0 THEN d + 1 ELSE d END AS d, p FROM o),
t1 AS (SELECT x.id AS old_id, y.id AS new_id, 1 AS tier FROM (SELECT c, d, p, min(id) AS id FROM a GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT c, d, p, min(id) AS id FROM b GROUP BY ALL HAVING count(*) = 1) y USING (c, d, p)),
t2 AS (SELECT x.id AS old_id, y.id AS new_id, 2 AS tier FROM (SELECT c, p, min(id) AS id FROM a WHERE id NOT IN (SELECT old_id FROM t1) GROUP BY c, p HAVING count(*) = 1) x JOIN (SELECT c, p, min(id) AS id FROM b WHERE id NOT IN (SELECT new_id FROM t1) GROUP BY c, p HAVING count(*) = 1) y USING (c, p))
SELECT old_id, new_id, CAST(tier AS BIGINT) AS tier FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)""")
def tiered_identities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"))
    new = o.withColumn("d", F.when(F.col("id") % 3 == 0, F.date_add("d", 1)).otherwise(F.col("d")))
    return incremental.matched_identities(o.filter("id % 2 = 0"), new, "id", [["c", "d", "p"], ["c", "p"]])


_DEDUP = """dd AS (SELECT event_id, event_date, CASE WHEN event_id % 3 <> 0 THEN venue END AS venue_id, venue AS venue_text, CAST((event_id % 6) * 240 AS INTEGER) AS start_min, genre AS name_key, CASE WHEN event_id % 13 = 0 THEN region END AS metro FROM ev)"""


def _dedup(spark, sf_dir):
    k = F.col("event_id")
    return events(spark, sf_dir).select("event_id", "event_date", F.when(k % 3 != 0, F.col("venue")).alias("venue_id"), F.col("venue").alias("venue_text"), ((k % 6) * 240).cast("int").alias("start_min"), F.col("genre").alias("name_key"), F.when(k % 13 == 0, F.col("region")).alias("metro"))


@query(f"""WITH {EVENTS_SQL}, {_DEDUP} SELECT a.event_id, b.event_id AS other_id, CASE WHEN a.venue_id = b.venue_id AND a.start_min = b.start_min THEN CASE WHEN a.metro <> b.metro THEN 'REVIEW' ELSE 'AUTO' END ELSE 'REVIEW' END AS rule
FROM dd a JOIN dd b ON a.event_date = b.event_date AND a.event_id < b.event_id WHERE a.venue_id = b.venue_id OR (a.start_min = b.start_min AND a.name_key = b.name_key) OR (a.venue_text = b.venue_text AND a.start_min = b.start_min AND a.venue_id IS NULL AND b.venue_id IS NULL)""")
def duplicate_pairs(spark, sf_dir):
    return duplicates.pairs(_dedup(spark, sf_dir))


_FITS = "r.name = x.name AND (r.metro IS NULL OR x.metro IS NULL OR r.metro = x.metro)"


@query(f"""WITH {EVENTS_SQL}, {_DEDUP}, g AS (SELECT list(struct_pack(id := event_id, name := name_key, metro := metro) ORDER BY event_id) AS xs FROM dd WHERE venue_id IS NOT NULL AND start_min IS NOT NULL GROUP BY event_date, venue_id, start_min),
w AS (SELECT list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda r: {_FITS})) = 0 THEN list_append(acc, struct_pack(root := x.id, name := x.name, metro := x.metro, ids := [x.id]))
ELSE list_transform(acc, lambda r, i: CASE WHEN i = list_position(list_transform(acc, lambda r: COALESCE({_FITS}, FALSE)), TRUE) THEN struct_pack(root := r.root, name := r.name, metro := COALESCE(r.metro, x.metro), ids := list_append(r.ids, x.id)) ELSE r END) END,
CAST([] AS STRUCT(root BIGINT, name VARCHAR, metro VARCHAR, ids BIGINT[])[])) AS roots FROM g), f AS (SELECT unnest(roots) AS r FROM w), e AS (SELECT unnest(r.ids) AS event_id, r.root AS canonical_id FROM f) SELECT event_id, canonical_id FROM e WHERE event_id <> canonical_id""")
def folded_events(spark, sf_dir):
    # a person has told apart what is listed under two names
    rows = _dedup(spark, sf_dir).filter("event_date is not null and venue_id is not null and start_min is not null")
    keys = ["event_date", "venue_id", "start_min"]
    named = rows.select(*keys, "event_id", "name_key")
    other = rows.select(*keys, F.col("event_id").alias("other_id"), F.col("name_key").alias("other_name"))
    blocked = named.join(other, keys).filter("name_key <> other_name and event_id < other_id").select("event_id", "other_id")
    return duplicates.folded(rows, blocked)


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT source_id AS group_id, event_id, CASE tier WHEN 'PRIMARY' THEN 0 WHEN 'OFFICIAL' THEN 1 WHEN 'COMMUNITY' THEN 2 ELSE 3 END AS t, CASE WHEN start_min IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN end_date IS NOT NULL THEN 1 ELSE 0 END AS points, event_id % 17 = 0 AS pinned FROM ev)
SELECT group_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pinned DESC, t, points DESC, event_id) AS k FROM m) WHERE k = 1""")
def representatives(spark, sf_dir):
    points = F.when(F.col("start_min").isNotNull(), 2).otherwise(0) + F.when(F.col("end_date").isNotNull(), 1).otherwise(0)
    tier = F.when(F.col("tier") == "PRIMARY", 0).when(F.col("tier") == "OFFICIAL", 1).when(F.col("tier") == "COMMUNITY", 2).otherwise(3)
    return duplicates.representatives(events(spark, sf_dir).select(F.col("source_id").alias("group_id"), "event_id", tier.alias("tier"), points.alias("points"), (F.col("event_id") % 17 == 0).alias("pinned")))


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT event_id, CAST(source_id AS VARCHAR) AS name_key, event_date AS f, COALESCE(end_date, event_date) AS l FROM ev)
SELECT a.event_id AS a_id, b.event_id AS b_id, CAST(greatest(0, date_diff('day', a.l, b.f), date_diff('day', b.l, a.f)) AS BIGINT) AS gap FROM p a JOIN p b ON a.name_key = b.name_key AND a.event_id < b.event_id WHERE (a.f <> b.f OR a.l <> b.l) AND greatest(0, date_diff('day', a.l, b.f), date_diff('day', b.l, a.f)) <= 20""")
def period_conflicts(spark, sf_dir):
    periods = events(spark, sf_dir).select("event_id", F.col("source_id").cast("string").alias("name_key"), F.col("event_date").alias("first_day"), F.coalesce("end_date", "event_date").alias("last_day"))
    return duplicates.period_conflicts(periods, 20)


@query(None)
def cross_post_components(spark, sf_dir):
    # even numbers are parts, odd ones suppliers
    lines = table(spark, sf_dir, "lineitem")
    return graphs.components(lines.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct())


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS parent FROM orders), r AS (SELECT node, parent AS ancestor, 1 AS depth FROM l WHERE parent IS NOT NULL AND parent <> node
UNION ALL SELECT r.node, l.parent, r.depth + 1 FROM r JOIN l ON l.node = r.ancestor WHERE l.parent IS NOT NULL) SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM r""")
def lineage(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 2).cast("long")).alias("parent"))
    return graphs.lineage(links).withColumn("depth", F.col("depth").cast("long"))


@query(None)
def independent_cliques(spark, sf_dir):
    return duplicates.greedy_clique(_independent(spark, sf_dir), "g")


@query(None)
def clique_members(spark, sf_dir):
    return duplicates.greedy_clique(_independent(spark, sf_dir), "g").groupBy("g").agg(F.count("*").alias("members"))


def _independent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_suppkey <> l_partkey").select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))


@query("""WITH q AS (SELECT c_custkey, 'Nation ' || c_nationkey AS t1, 'NATION_' || (c_nationkey % 7) AS t2 FROM customer), k AS (SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS key FROM nation)
SELECT c_custkey, COALESCE(a.n_nationkey, b.n_nationkey) AS place FROM q LEFT JOIN k a ON a.key = CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(lower(t1), '[^a-z0-9]', '', 'g') ELSE 'nothing' END LEFT JOIN k b ON b.key = regexp_replace(lower(t2), '[^a-z0-9]', '', 'g')""")
def alias_resolution(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("alias"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).otherwise(F.lit("nothing")), F.concat(F.lit("NATION_"), (F.col("c_nationkey") % 7).cast("string"))).alias("attempts"))
    return resolution.resolved(asked, "c_custkey", "attempts", places, folded_key)


@query(None)
def place_suggestions(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("alias"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Natoin "), F.col("s_nationkey").cast("string")).alias("text"))
    return resolution.suggestions(asked, "s_suppkey", "text", places, folded_key, similarity, 3)


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey AS gt, o_orderdate FROM orders), g AS (SELECT c_custkey AS gt FROM customer WHERE c_custkey % 2 = 0)
SELECT 'missed' AS kind, g.gt FROM g LEFT JOIN d USING (gt) WHERE d.id IS NULL UNION ALL SELECT DISTINCT 'unmatched', d.gt FROM d LEFT JOIN g USING (gt) WHERE g.gt IS NULL UNION ALL SELECT 'repeated', gt FROM d JOIN g USING (gt) GROUP BY gt HAVING count(*) > 15""")
def reconciled_validation(spark, sf_dir):
    truth = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("gt"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gt"))
    return resolution.reconciled(truth, found, "gt", 15)


_PAIR_SQL = """SELECT a.event_id, b.event_id AS other_id, CASE WHEN a.venue_id = b.venue_id AND a.start_min = b.start_min THEN CASE WHEN a.metro <> b.metro THEN 'REVIEW' ELSE 'AUTO' END ELSE 'REVIEW' END AS rule
FROM {0} a JOIN {0} b ON a.event_date = b.event_date AND a.event_id < b.event_id WHERE a.venue_id = b.venue_id OR (a.start_min = b.start_min AND a.name_key = b.name_key) OR (a.venue_text = b.venue_text AND a.start_min = b.start_min AND a.venue_id IS NULL AND b.venue_id IS NULL)"""


@query(f"""WITH {EVENTS_SQL}, {_DEDUP}, links AS (SELECT n_name FROM nation WHERE n_regionkey = 1), aa AS (SELECT dd.* REPLACE (CASE WHEN venue_id IS NULL AND venue_text IN (SELECT n_name FROM links) THEN venue_text ELSE venue_id END AS venue_id) FROM dd),
p AS ({_PAIR_SQL.format("dd")}), q AS ({_PAIR_SQL.format("aa")}) SELECT COALESCE(p.event_id, q.event_id) AS event_id, COALESCE(p.other_id, q.other_id) AS other_id, p.rule AS "before", q.rule AS "after" FROM p FULL JOIN q ON p.event_id = q.event_id AND p.other_id = q.other_id WHERE p.rule IS DISTINCT FROM q.rule""")
def link_preview(spark, sf_dir):
    """What linking the texts of one region's nations to their places would change among pairs."""
    links = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("venue_text"), F.col("n_name").alias("venue_id"), F.lit(None).cast("string").alias("metro"))
    return previews.changed_pairs(_dedup(spark, sf_dir), links)
