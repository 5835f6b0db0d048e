"""Posts written from orders, read back into candidates; corrections, states and verification on top."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import announcements
from .registry import query, table


def posts(spark, sf_dir):
    """One post an order: a title by kind, then day (7305 days on: years start with 20), clock, fee and place on lines of their own, in changing forms."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 7305)
    y, m, d = F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")
    pick = lambda n, *forms: F.element_at(F.array(*forms), (k % n + 1).cast("int"))
    dated = pick(4, F.concat_ws(".", y, m, d), F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일")), F.concat(m, F.lit("월 "), d, F.lit("일")), F.concat(m, F.lit("/"), d))
    clock = pick(3, F.lit("PM 7:30~11:00"), F.lit("오후 8시~1시"), F.lit("20:00 - 23:30"))
    priced = pick(5, F.lit("입장료 13,000원"), F.lit("참가비: 8천원"), F.lit("무료"), F.lit("fee 15,000원 / entry 20,000원"), F.lit("주차 7,000원"))
    title = pick(4, F.lit("Friday milonga"), F.lit("Tango workshop and milonga"), F.lit("Salsa social"), F.lit("Photos of the night"))
    body = F.concat_ws("\n", dated, clock, priced, F.concat(F.lit("장소: "), "n_name"))
    return orders.select(k.alias("post_id"), title.alias("title"), body.alias("body"), F.date_sub(day, 20).alias("published"), F.when(k % 7 == 0, "FESTIVAL").alias("known_kind"))


_CANDIDATES = """c AS (SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 4 = 3 THEN 'OTHER' WHEN o_orderkey % 7 = 0 THEN 'FESTIVAL' WHEN o_orderkey % 4 = 0 THEN 'MILONGA' WHEN o_orderkey % 4 = 1 THEN 'MILONGA_WITH_CLASS' ELSE 'SOCIAL' END AS kind, CAST(o_orderdate AS DATE) + 7305 AS event_date,
CAST(CASE o_orderkey % 3 WHEN 0 THEN 1170 ELSE 1200 END AS BIGINT) AS start_min, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1380 WHEN 1 THEN 60 ELSE 1410 END AS BIGINT) AS end_min, CAST(CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS end_day_offset,
CASE o_orderkey % 3 WHEN 2 THEN 'ABSENT' ELSE 'PROPAGATED' END AS time_evidence, CAST(CASE o_orderkey % 5 WHEN 0 THEN 13000 WHEN 1 THEN 8000 WHEN 2 THEN 0 END AS BIGINT) AS fee, CASE o_orderkey % 5 WHEN 0 THEN '13000' WHEN 1 THEN '8000' WHEN 2 THEN '0' WHEN 3 THEN '15000/20000' END AS fee_options, n_name AS venue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {_CANDIDATES} SELECT * FROM c")
def extracted_candidates(spark, sf_dir):
    found = announcements.candidates(posts(spark, sf_dir)).drop("nth")
    return found.withColumns({c: F.col(c).cast("long") for c in ("start_min", "end_min", "end_day_offset")})


@query(f"WITH {_CANDIDATES}, e AS (UNPIVOT (SELECT post_id, CAST(event_date AS VARCHAR) AS event_date, CAST(start_min AS VARCHAR) AS start_min, CAST(fee AS VARCHAR) AS fee, venue FROM c) ON event_date, start_min, fee, venue INTO NAME field VALUE value) SELECT field, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS n_values FROM e GROUP BY field")
def evidence_pivot(spark, sf_dir):
    found = announcements.evidences(announcements.candidates(posts(spark, sf_dir)).drop("end_min"))
    return found.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def _sightings(spark, sf_dir):
    """Line items as evidence of their order's fields: ship mode by flag, trusted where the supplier is even."""
    lines = table(spark, sf_dir, "lineitem")
    field = F.element_at(F.array(*[F.lit(f) for f in announcements.CORE]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return lines.select(F.col("l_orderkey").alias("event_id"), field.alias("field"), F.floor(F.col("l_quantity") / 25).cast("string").alias("value"), F.when(F.col("l_suppkey") % 3 != 0, "ORGANIZER").otherwise("AGGREGATOR").alias("role"), F.when(F.col("l_returnflag") != "R", "TEXT").otherwise("GUESS").alias("kind"))


_STATES = """s AS (SELECT l_orderkey AS event_id, CASE l_linenumber % 4 WHEN 0 THEN 'event_date' WHEN 1 THEN 'start_min' WHEN 2 THEN 'end_min' ELSE 'fee' END AS field, CAST(CAST(floor(l_quantity / 25) AS BIGINT) AS VARCHAR) AS value, l_suppkey % 3 <> 0 AND l_returnflag <> 'R' AS sure, l_returnflag <> 'R' AS texted FROM lineitem),
f AS (SELECT event_id, field, CASE WHEN count(DISTINCT value) FILTER (WHERE sure) > 1 THEN 'CONFLICT' WHEN count(DISTINCT value) FILTER (WHERE sure) = 1 THEN 'VERIFIED' WHEN count(*) FILTER (WHERE texted) > 0 THEN 'EXPECTED' ELSE 'INFERRED' END AS state,
CASE WHEN count(DISTINCT value) FILTER (WHERE sure) <= 1 THEN COALESCE(max(value) FILTER (WHERE sure), max(value) FILTER (WHERE texted), max(value)) END AS value FROM s GROUP BY 1, 2)"""


@query(f"WITH {_STATES} SELECT event_id, field, state, value FROM f")
def field_states(spark, sf_dir):
    return announcements.field_states(_sightings(spark, sf_dir), ["event_id"])


@query(f"WITH {_STATES} SELECT event_id, count(*) FILTER (WHERE state = 'VERIFIED') = 4 AND NOT bool_or(state = 'CONFLICT') AS verified, CASE WHEN bool_or(state = 'CONFLICT') THEN 'CONFLICT' WHEN count(*) FILTER (WHERE state = 'VERIFIED') = 4 THEN 'VERIFIED' WHEN count(*) FILTER (WHERE state = 'VERIFIED') > 0 THEN 'POSSIBLE' ELSE 'DISCOVERED' END AS confidence FROM f GROUP BY event_id")
def verified_events(spark, sf_dir):
    return announcements.verified(announcements.field_states(_sightings(spark, sf_dir), ["event_id"]), ["event_id"])


@query("""WITH x AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'seg' ELSE 'status' END AS field, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) AS r FROM lineitem)
SELECT o_orderkey AS k, CASE WHEN a.k IS NOT NULL THEN a.value ELSE o_orderpriority END AS seg, CASE WHEN b.k IS NOT NULL THEN b.value ELSE o_orderstatus END AS status FROM orders LEFT JOIN x a ON a.k = o_orderkey AND a.field = 'seg' AND a.r = 1 LEFT JOIN x b ON b.k = o_orderkey AND b.field = 'status' AND b.r = 1""")
def corrections_overlay(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("seg"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem")
    fixes = lines.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, "seg").otherwise("status").alias("field"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("value"), F.struct("l_shipdate", "l_linenumber", "l_extendedprice").alias("at"))
    return announcements.corrected(rows, fixes, "k", ["seg", "status"])


def _dotted(day):
    return F.concat_ws(".", F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string"))


@query("""WITH p AS (SELECT o_orderkey AS post_id, CAST(o_orderdate AS DATE) + 7305 AS a, CAST(o_orderdate AS DATE) + 7305 + CAST(o_orderkey % 9 AS INTEGER) AS b FROM orders)
SELECT post_id, a AS first_day, b AS last_day, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS night FROM p WHERE b > a""")
def festival_nights(spark, sf_dir):
    return _festival_nights(table(spark, sf_dir, "orders"))


def _festival_nights(orders):
    first = F.date_add(F.to_date("o_orderdate"), 7305)
    last = F.date_add(first, (F.col("o_orderkey") % 9).cast("int"))
    told = F.concat(_dotted(first), F.lit(" ~ "), F.month(last).cast("string"), F.lit("."), F.dayofmonth(last).cast("string"), F.lit(" festival"))
    posts_ = orders.select(F.col("o_orderkey").alias("post_id"), F.lit("Tango festival").alias("title"), told.alias("body"))
    return announcements.festivals(posts_)


@query("""SELECT l_orderkey AS post_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name) - 1 AS BIGINT) AS nth, p_name AS name, CAST((12 + l_linenumber) * 60 AS BIGINT) AS start_min, CAST((12 + l_linenumber) * 60 + 90 AS BIGINT) AS end_min FROM lineitem JOIN part ON p_partkey = l_partkey""")
def programme_lines(spark, sf_dir):
    return _programme_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def _programme_lines(lines, parts):
    lines = lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    clock = F.format_string("PM %d:00~%d:30", F.col("l_linenumber"), F.col("l_linenumber") + 1)
    told = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws(" ", "p_name", clock).alias("line"))))
    posts_ = lines.groupBy(F.col("l_orderkey").alias("post_id")).agg(F.array_join(told.getField("line"), "\n").alias("body"))
    found = announcements.programmes(posts_).drop("end_day_offset")
    return found.withColumns({c: F.col(c).cast("long") for c in ("nth", "start_min", "end_min")})


@query("""WITH p AS (SELECT s_suppkey AS post_id, DATE '2026-09-16' AS published, s_suppkey % 7 AS open_day, s_suppkey % 5 = 0 AS off FROM supplier)
SELECT post_id, published + CAST((open_day - 2 + 7) % 7 AS INTEGER) AS day, CAST(1200 AS BIGINT) AS start_min, CAST(1380 AS BIGINT) AS end_min FROM p WHERE NOT off""")
def weekly_days(spark, sf_dir):
    names = F.array(*[F.lit(w) for w in "월화수목금토일"])
    k = F.col("s_suppkey")
    body = F.concat(F.element_at(names, (k % 7 + 1).cast("int")), F.lit("요일: "), F.when(k % 5 == 0, "휴무").otherwise("PM 8:00~11:00"))
    posts_ = table(spark, sf_dir, "supplier").select(k.alias("post_id"), body.alias("body"), F.lit("2026-09-16").cast("date").alias("published"))
    return announcements.weekly(posts_).withColumns({c: F.col(c).cast("long") for c in ("start_min", "end_min")})


@query(f"WITH {_CANDIDATES} SELECT post_id, event_date, CASE WHEN post_id % 2 = 0 THEN start_min ELSE 1140 END AS start_min, COALESCE(fee, 9000) AS fee, concat_ws(',', CASE WHEN post_id % 2 = 1 THEN 'start_min' END, CASE WHEN fee IS NULL THEN 'fee' END) AS filled FROM c")
def image_fallback(spark, sf_dir):
    return _image_fallback(posts(spark, sf_dir))


def _image_fallback(told):
    found = announcements.candidates(told).withColumn("start_min", F.when(F.col("post_id") % 2 == 0, F.col("start_min")))
    ocr = told.select("post_id", F.lit("PM 7:00~9:00\n입장료 9,000원").alias("ocr_text"), "published")
    return announcements.filled_from_images(found, ocr).select("post_id", "event_date", F.col("start_min").cast("long").alias("start_min"), "fee", "filled")


_TOLD = """t AS (SELECT o_orderkey AS post_id, o_orderkey % 6 IN (0, 5) AS titled, o_orderkey % 4 AS line, o_orderkey % 5 IN (0, 1) AS priced, o_orderkey % 7 IN (0, 1) AS taught, o_orderkey % 3 = 0 AS enrol, o_orderkey % 11 = 0 AS recap, o_orderkey % 8 > 0 AS dated FROM orders)"""


@query(f"""WITH {_TOLD} SELECT post_id, titled OR line = 1 AS social, dated AND line = 2 AND priced AS party, taught AND enrol AS course, titled AND dated AND line IN (1, 2) AS night, recap FROM t""")
def evidence_bundles(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.concat(F.when(k % 6 == 0, "Friday party").when(k % 6 == 5, "금요 소셜").otherwise("News of the house"), F.when(k % 11 == 0, " 후기").otherwise(""))
    lines = (
        F.when(k % 8 > 0, F.concat_ws(".", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"))).otherwise("soon"),
        F.when(k % 4 == 1, "social dance PM 8:00~11:00").when(k % 4 == 2, "doors PM 7:30~12:00").when(k % 4 == 3, "a social that states no clock").otherwise("nothing more"),
        F.when(k % 5 <= 1, "입장료 12,000원").otherwise("bring friends"),
        F.when(k % 7 <= 1, "lesson for beginners").otherwise("music by the house"),
        F.when(k % 3 == 0, "register at the desk").otherwise("see you"),
    )
    told = table(spark, sf_dir, "orders").select(k.alias("post_id"), announcements.evidence(title, F.concat_ws("\n", *lines), F.date_add(F.to_date("o_orderdate"), -3)).alias("e"))
    return told.select("post_id", "e.*")


#: What a post says: in its title, or in a line of its body; and the orders that say it.
_TITLE_SAYS = {"recap": ("후기", "o_orderkey % 17 = 0"), "lesson": ("레슨", "o_orderkey % 6 = 0"), "social": ("파티", "o_custkey % 5 = 0"), "night": ("밀롱가", "o_custkey % 7 = 0")}
_BODY_SAYS = {
    "class": ("워크숍 안내", "o_custkey % 3 = 0"), "open": ("오픈클래스 있습니다", "o_orderkey % 4 = 0"), "enrol": ("수강 신청", "o_custkey % 4 = 0"), "night_line": ("밀롱가 20:00-23:30", "o_orderkey % 5 = 1"),
    "social_line": ("소셜 21시", "o_orderkey % 13 = 0"), "doors": ("입장 19:30 부터", "o_orderkey % 3 = 0"), "day": ("2026.8.14", "o_custkey % 2 = 0"), "clock": ("20:00-23:30", "o_orderkey % 2 = 0"),
    "fee": ("입장료 15000원", "o_orderkey % 3 < 2"), "place": ("장소: 강변홀", "o_orderkey % 7 < 4"),
}
_SAID = ", ".join(f"({when}) AS {name}" for name, (_, when) in (_TITLE_SAYS | _BODY_SAYS).items() if name not in ("class", "night")) + ", (o_custkey % 3 = 0) AS teaches, (o_custkey % 7 = 0) AS night_title"


@query(f"""WITH o AS (SELECT o_orderkey, {_SAID}, o_orderkey % 9 = 0 AS listed, o_orderkey % 11 = 0 AS filed, o_orderkey % 23 = 0 AS known, o_orderkey % 29 = 0 AS festival, o_orderkey % 8 = 0 AS structured FROM orders),
t AS (SELECT *, clock OR night_line AS timed, social OR social_line AS sociable, night_title OR night_line AS nightly, (teaches AND enrol) OR (filed AND NOT listed) AS course, day AND doors AND fee AS party FROM o)
SELECT o_orderkey AS post_id, CASE WHEN recap THEN 'OTHER' WHEN known THEN 'MILONGA' WHEN festival THEN 'FESTIVAL' WHEN teaches AND nightly AND open THEN 'MILONGA_WITH_CLASS' WHEN teaches AND ((sociable AND NOT course) OR party) THEN 'SOCIAL_WITH_CLASS'
WHEN teaches AND (night_title OR social) AND day AND timed THEN 'MILONGA_WITH_CLASS' WHEN teaches AND listed AND day AND timed THEN 'SOCIAL_WITH_CLASS' WHEN teaches THEN 'CLASS' WHEN lesson AND ((sociable AND NOT course) OR party) THEN 'SOCIAL_WITH_CLASS'
WHEN lesson AND NOT (night_title AND night_line) THEN 'CLASS' WHEN NOT lesson AND course THEN 'CLASS' WHEN nightly THEN 'MILONGA' WHEN sociable OR (day AND timed AND place) THEN 'SOCIAL' WHEN structured THEN 'SOCIAL' ELSE 'OTHER' END AS kind FROM t""")
def classified_posts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    said = lambda table_, *more: F.array_compact(F.array(*more, *[F.when(F.expr(when), F.lit(phrase)) for phrase, when in table_.values()]))
    lines = said(_BODY_SAYS, F.col("o_orderpriority"))
    k = F.col("o_orderkey")
    posts = orders.select(
        k.alias("post_id"),
        F.array_join(said(_TITLE_SAYS, F.lit("a name")), " ").alias("title"),
        F.array_join(F.when(k % 2 == 0, lines).otherwise(F.reverse(lines)), "\n").alias("body"),
        F.lit("2026-07-01").cast("date").alias("published"),
        F.when(k % 9 == 0, "PARTY").when(k % 11 == 0, "LESSON").alias("category"),
        F.when(k % 23 == 0, "MILONGA").alias("known_kind"),
        F.when(k % 29 == 0, "FESTIVAL").alias("record_format"),
        F.when(k % 8 == 0, "SOCIAL").alias("fallback"),
    )
    # one small file: its posts are dealt out before they are read
    return announcements.classified(posts.repartition("post_id")).select("post_id", "kind")
