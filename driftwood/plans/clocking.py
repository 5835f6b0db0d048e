"""Notices written from orders, whose own clock, roles of days and ordinal weekdays are read; verdicts on stored times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks
from ..functions.extraction import WEEKDAYS
from .registry import query, table

MILONGA = "밀롱가|milonga"


def _lines(*lines):
    return F.concat_ws("\n", *lines)


def _pick(number, *forms):
    """The form of the number; null stands for a line left out."""
    return F.element_at(F.array(*[F.lit(f).cast("string") for f in forms]), (number % len(forms) + 1).cast("int"))


@query("""WITH t AS (SELECT o_orderkey AS post_id, o_orderkey % 5 = 0 AS labelled, o_orderkey % 4 AS own FROM orders)
SELECT post_id, CAST(CASE WHEN labelled AND own <> 1 THEN 1080 WHEN own = 0 THEN 1200 WHEN own = 1 THEN 1260 WHEN own = 2 THEN 1140 END AS BIGINT) AS start_min,
CAST(CASE WHEN labelled AND own <> 1 THEN 1410 WHEN own = 0 THEN 1410 WHEN own = 1 THEN 0 WHEN own = 2 THEN 1380 END AS BIGINT) AS end_min FROM t""")
def own_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    told = _lines(
        F.when(k % 5 == 0, "일시: 18:00 ~ 23:30"),
        _pick(k % 3, None, "workshop PM 3:00~4:30", "PM 3:00~4:30 workshop"),
        _pick(k % 4, "milonga PM 8:00~11:30", "PM 9:00~12:00 milonga", "PM 7:00~11:00", None),
    )
    found = table(spark, sf_dir, "orders").select(k.alias("post_id"), clocks.own_range(told, MILONGA).alias("t"))
    return found.select("post_id", F.col("t.start_min").cast("long").alias("start_min"), F.col("t.end_min").cast("long").alias("end_min"))


@query("""SELECT o_orderkey AS post_id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 1260 WHEN o_orderkey % 4 < 3 THEN 1230 END AS BIGINT) AS start_min FROM orders""")
def start_times(spark, sf_dir):
    k = F.col("o_orderkey")
    told = _lines(
        F.when(k % 5 == 0, "social PM 6:00~7:00"),
        _pick(k % 7, None, "lesson PM 7:00", "until 05:00", "milonga 10시부터", "11월 모임", None, None),
        _pick(k % 4, "milonga open PM 9:00", "PM 8:30 milonga", "see you PM 8:30", "PM 8:30\nthen 19:45"),
    )
    return table(spark, sf_dir, "orders").select(k.alias("post_id"), clocks.start_min(told, MILONGA).cast("long").alias("start_min"))


@query("""WITH t AS (SELECT o_orderkey AS post_id, o_orderkey % 4 AS form, CAST(o_orderdate AS DATE) + 7305 AS d FROM orders)
SELECT post_id, d AS day, CASE form WHEN 0 THEN 'EVENT' ELSE 'DEADLINE' END AS role FROM t UNION ALL SELECT post_id, d + 3, 'DEADLINE' FROM t WHERE form = 2 UNION ALL SELECT post_id, d + 5, 'EVENT' FROM t WHERE form = 3""")
def day_roles(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 7305)
    on = lambda n: F.date_format(F.date_add(day, n), "yyyy.M.d")
    told = (
        F.when(k % 4 == 0, F.concat(F.lit("See you on "), on(0)))
        .when(k % 4 == 1, F.concat(on(0), F.lit("(금) 까지")))
        .when(k % 4 == 2, F.concat(F.lit("신청 기간: "), on(0), F.lit(" ~ "), on(3)))
        .otherwise(F.concat(on(0), F.lit(" 신청 마감 "), on(5)))
    )
    return table(spark, sf_dir, "orders").select(k.alias("post_id"), F.explode(clocks.day_roles(told)).alias("r")).select("post_id", "r.*")


@query("""WITH t AS (SELECT o_orderkey AS post_id, CAST(o_orderdate AS DATE) + 7285 AS published, month(CAST(o_orderdate AS DATE) + 7305) AS m, CAST(o_orderkey % 7 AS INTEGER) AS w, CAST(o_orderkey % 6 AS INTEGER) + 1 AS n FROM orders),
f AS (SELECT *, make_date(year(published) + unnest([-1, 0, 1]), m, 1) AS first FROM t),
d AS (SELECT *, CASE WHEN n = 6 THEN last_day(first) - CAST((isodow(last_day(first)) - 1 - w + 7) % 7 AS INTEGER) ELSE first + CAST((w - isodow(first) + 8) % 7 + 7 * (n - 1) AS INTEGER) END AS day FROM f)
SELECT post_id, arg_min(day, (abs(day - published), day)) FILTER (WHERE abs(day - published) <= 200 AND month(day) = m) AS day FROM d GROUP BY post_id""")
def month_ordinals(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 7305)
    told = F.concat(F.month(day).cast("string"), F.lit("월 "), _pick(k % 6, "첫째", "둘째", "셋째", "넷째", "다섯째", "마지막"), F.lit("주 "), _pick(k % 7, *WEEKDAYS), F.lit("요일"))
    return table(spark, sf_dir, "orders").select(k.alias("post_id"), clocks.month_ordinal(told, F.date_sub(day, 20)).alias("day"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'https://img/' || l_partkey WHEN 1 THEN 'ABSENT' END AS inference, CASE l_returnflag WHEN 'R' THEN '{"meridiem_evidence": "EXPLICIT", "ambiguous": false}' WHEN 'A' THEN '{"meridiem_evidence": "ABSENT", "ambiguous": ' || CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END || '}' END AS value FROM lineitem),
v AS (SELECT *, CASE WHEN inference = 'ABSENT' THEN inference ELSE json_extract_string(value, '$.meridiem_evidence') END AS verdict FROM t)
SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN verdict = 'ABSENT' AND json_extract_string(value, '$.ambiguous') = 'false' THEN 'UNAMBIGUOUS' ELSE verdict END AS verdict FROM v) GROUP BY verdict""")
def time_verdicts(spark, sf_dir):
    inference = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("https://img/"), F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") % 3 == 1, "ABSENT")
    reading = F.struct(F.when(F.col("l_returnflag") == "R", "EXPLICIT").otherwise("ABSENT").alias("meridiem_evidence"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25)).alias("ambiguous"))
    value = F.when(F.col("l_returnflag").isin("R", "A"), F.to_json(reading))
    return table(spark, sf_dir, "lineitem").select(clocks.time_verdict(inference, value).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))
