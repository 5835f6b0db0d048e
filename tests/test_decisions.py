"""The decision list against a plain second reading, over documents' lines with planted phrases at any place."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from driftwood.operators import announcements

SF = "/root/testdata/sf0.001"
POST = "post_id long, title string, body string, published date, category string, known_kind string, record_format string, fallback string, planted array<string>"
TITLE = {"recap": "후기", "lesson": "레슨", "social_title": "파티", "milonga_title": "밀롱가"}
BODY = {"class": "워크숍 안내", "open": "오픈클래스 있습니다", "enrol": "수강 신청", "milonga": "밀롱가 at night", "milonga_clock": "밀롱가 20:00-23:30", "social_clock": "소셜 21시", "doors": "입장 19:30 부터", "day": "2026.8.14", "clock": "20:00-23:30", "fee": "입장료 15000원", "venue": "장소: 강변홀"}


def second_reading(planted, category, known, record, fallback):
    p = set(planted)
    clock = bool(p & {"clock", "milonga_clock"})
    day = "day" in p
    social = bool(p & {"social_title", "social_clock"})
    milonga = bool(p & {"milonga_title", "milonga", "milonga_clock"})
    course = ("class" in p and "enrol" in p) or category == "LESSON"
    party = day and "doors" in p and "fee" in p
    night = bool(p & {"milonga_title", "social_title"}) and day and clock
    teaches = "class" in p
    if "recap" in p:
        return "OTHER"
    if known:
        return known
    if record == "FESTIVAL":
        return "FESTIVAL"
    if teaches:
        if milonga and "open" in p:
            return "MILONGA_WITH_CLASS"
        if (social and not course) or party:
            return "SOCIAL_WITH_CLASS"
        if night:
            return "MILONGA_WITH_CLASS"
        return "SOCIAL_WITH_CLASS" if category == "PARTY" and day and clock else "CLASS"
    if "lesson" in p:
        if (social and not course) or party:
            return "SOCIAL_WITH_CLASS"
        if not ("milonga_title" in p and "milonga_clock" in p):
            return "CLASS"
    elif course:
        return "CLASS"
    if milonga:
        return "MILONGA"
    if social or (day and clock and "venue" in p):
        return "SOCIAL"
    return fallback if fallback in ("MILONGA", "SOCIAL") else "OTHER"


def corpus(spark, n=1500):
    rnd = random.Random(8)
    prose = [line for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for line in (t or "").split("\n") if line and not any(c.isdigit() or c == "@" for c in line)]
    rows = []
    # a dated announcement of a place in no words of any scene is rare among random ones
    for k in range(n):
        title = [w for w in TITLE if rnd.random() < (0.08 if w == "recap" else 0.2)]
        dense = rnd.choice([0.15, 0.35, 0.6])
        body = [w for w in BODY if rnd.random() < dense]
        if k % 60 == 0:
            title, body = [], ["day", "clock", "venue", *(w for w in ("fee", "doors", "open") if rnd.random() < 0.5)]
        lines = [BODY[w] for w in body] + [rnd.choice(prose)[:300] for _ in range(rnd.randrange(4))]
        rnd.shuffle(lines)
        head = [TITLE[w] for w in title] + [rnd.choice(prose)[:30]]
        rnd.shuffle(head)
        rows.append((k, " ".join(head), "\n".join(lines), dt.date(2026, 7, 1), rnd.choice([None, "PARTY", "NEWS", "LESSON"]), rnd.choice([None] * 12 + ["MILONGA"]), rnd.choice([None] * 12 + ["FESTIVAL", "WEEK"]), rnd.choice([None, None, "SOCIAL", "CLASS", "nonsense"]), title + body))
    return rows


def test_kinds_match_a_second_reading_and_every_rule_decides_some(spark):
    rows = corpus(spark)
    found = announcements.classified(spark.createDataFrame(rows, POST).repartition(4)).collect()
    wrong = [(r["planted"], r["kind"], r["rule"]) for r in found if r["kind"] != second_reading(r["planted"], r["category"], r["known_kind"], r["record_format"], r["fallback"])]
    assert not wrong
    assert {r["rule"] for r in found} == {name for name, *_ in announcements.RULES} | {"none"}


def test_each_rule_changes_what_the_others_would_say(spark):
    """Without a rule, some row that it decided gets another kind."""
    rows = spark.createDataFrame(corpus(spark, 900), POST).repartition(4)
    t = announcements.traits(F.col("title"), F.col("body"), F.col("published"), F.col("category"))
    flat = rows.withColumn("_t", t)
    holds = flat.select("post_id", *[F.coalesce(rule(F.col("_t")), F.lit(False)).alias(f"r{k}") for k, (_, rule, _) in enumerate(announcements.RULES)], *[announcements.given(kind).alias(f"k{k}") for k, (_, _, kind) in enumerate(announcements.RULES)]).collect()
    n = len(announcements.RULES)
    decide = lambda row, without: next((row[f"k{k}"] for k in range(n) if k != without and row[f"r{k}"]), "OTHER")
    flips = {k for k, row in itertools.product(range(n), holds) if decide(row, None) != decide(row, k)}
    assert flips == set(range(n))
