"""Pairs, guards, the content store and validation on small fixtures of their own."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftwood.operators import announcements, contents, guards, pairs, summaries, validation


def one(spark, **values):
    return spark.createDataFrame([Row(**values)])


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Milonga Carla", "Harbour | Milonga Carla", True),
        ("Lake Dance Days 2027", "Lake Dance Days 2027 (north shore)", True),
        ("blue barn", "BlueBarn", True),
        ("spring closing", "spring lessons", False),
        ("Milonga", "Salsa Party", False),
        (None, "Carla", False),
    ],
)
def test_names_name_one_night(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(pairs.names_match(pairs.name_words(F.col("a")), pairs.name_words(F.col("b")))).first()
    assert row[0] is same


def test_unknown_fields_are_no_evidence(spark):
    side = "struct<words:array<string>,start_min:int,venue_id:long,source_id:long,end_date:date,festival:boolean>"
    none = (["carla"], None, None, 1, None, False)
    rows = [
        (1, none, (["carla"], None, None, 2, None, False)),
        (2, (["carla"], 1200, None, 1, None, False), (["carla"], 1200, None, 1, None, False)),
        (3, (["carla"], 1200, 7, 1, None, False), (["carla"], 1260, 7, 2, None, False)),
        (4, (["carla"], 1200, 7, 1, None, False), (["carla"], 1200, 8, 2, None, False)),
        (5, (["x"], None, None, 1, dt.date(2024, 1, 3), True), (["x"], None, None, 2, dt.date(2024, 1, 4), True)),
        (6, (["x"], None, None, 1, None, True), (["x"], None, None, 2, dt.date(2024, 1, 4), True)),
    ]
    found = {r["k"]: (r["why"], r["strength"]) for r in pairs.readiness(spark.createDataFrame(rows, f"k int, a {side}, b {side}")).collect()}
    assert found == {1: (None, "WEAK"), 2: ("NAME_AND_START", "MODERATE"), 3: ("NAME_AND_PLACE_OF_TWO_SOURCES", "STRONG"), 4: (None, "WEAK"), 5: (None, "WEAK"), 6: ("FESTIVAL_OF_TWO_SOURCES", "STRONG")}


def test_a_guard_reads_the_last_outcomes_only(spark):
    rows = [("a", k, True, k > 5, False, False) for k in range(30)] + [("b", k, True, True, k == 3, k == 3) for k in range(4)] + [("c", k, True, k != 19, False, False) for k in range(20)]
    log = spark.createDataFrame(rows, "key string, at long, predicted boolean, actual boolean, regression boolean, critical boolean")
    found = {(r["key"], r["size"]): r["status"] for r in guards.runtime_guard(log, "key", [F.desc("at")]).collect()}
    # of a the wrong ones are too old; b has a critical one; c one false positive among the last, all its negatives
    assert [found["a", s] for s in (5, 10, 20)] == ["HEALTHY"] * 3 and found["b", 5] == "ROLLBACK" and found["c", 5] == "ROLLBACK"


def test_context_features_that_nobody_knows_count_half(spark):
    kind = "struct<scope_type:string,source_id:string,platform:string,rule_key:string,secondary_cause:string,alternative_route:string>"
    row = spark.createDataFrame([(("s", "1", "p", "r", "c", "y"), ("s", "2", None, "r", None, "y"))], f"own {kind}, asked {kind}")
    assert row.select(guards.context_similarity(F.col("own"), F.col("asked"))).first()[0] == pytest.approx(0.15 + 0.2 + 0.075 + 0.1 + 0.05 + 0.1)


def test_rows_leave_the_queue_once_read(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        (1, "FETCHED_FULL", True, 0, day(5), day(5), None, None, 0),
        (2, "FETCHED_FULL", True, 0, day(5), day(5), day(6), "v2", 0),
        (3, "FETCH_BLOCKED", False, 2, None, day(9), day(6), "v2", 0),
        (4, "FETCHED_PARTIAL", True, 0, day(5), day(5), day(6), "v1", 0),
        (5, "FETCHED_PARTIAL", True, 0, day(5), day(5), day(6), "v1", 3),
        (6, "FETCH_BLOCKED", False, 0, None, day(9), None, None, 0),
    ]
    items = spark.createDataFrame(rows, "item_id long, status string, has_text boolean, posters int, fetched_at timestamp, updated_at timestamp, reread_at timestamp, read_by string, reread_attempts int")
    assert {r["item_id"]: r["reasons"] for r in contents.to_reread(items, "v2").collect()} == {1: "BODY_ARRIVED,VERSION_CHANGED", 3: "POSTER_GAINED", 4: "VERSION_CHANGED"}
    assert contents.backlog(items, "v2").first().asDict() == {"waiting": 3, "body_arrived": 1, "poster_gained": 1, "version_changed": 2, "given_up": 1}


def sample(spark, detected, verified, touched, wrong=0):
    """28 held events, of which some are detected, verified and touched, on 14 days."""
    day = lambda k: dt.date(2026, 8, 1 + k % 14)
    truth = [(k, day(k), "HELD", day(k), "20:00", 10000, "Hall") for k in range(28)]
    found = [(k, day(k), "VERIFIED" if k < verified else "POSSIBLE", day(k), "20:00", 10000 + (k < wrong), " hall", k < touched, False, False) for k in range(detected)]
    a = spark.createDataFrame(truth, "gt_id long, day date, status string, g_date date, g_time string, g_fee long, g_venue string")
    b = spark.createDataFrame(found, "gt_id long, day date, status string, f_date date, f_time string, f_fee long, f_venue string, touched boolean, hallucinated boolean, cancel_miss boolean")
    return validation.judged(validation.compared(a, b)).first()


def test_the_published_sample_passes_the_gate(spark):
    r = sample(spark, 25, 24, 4)
    assert (r["recall"], r["precision"], r["human_touch"], r["gate"]) == (0.8929, 1.0, 0.16, "PASS")


def test_the_failing_sample_fails_and_a_weak_one_passes_conditionally(spark):
    bad = sample(spark, 24, 24, 4, wrong=1)
    assert (bad["recall"], bad["precision"], bad["false_verified"], bad["gate"]) == (0.8571, 0.9583, 1, "FAIL")
    assert sample(spark, 23, 22, 5)["gate"] == "CONDITIONAL_PASS" and sample(spark, 20, 20, 0)["gate"] == "FAIL"


def test_found_rows_are_sorted_once_and_narrow_and_counted_as_told(spark):
    day = lambda k: dt.date(2026, 8, 1 + k % 3)
    truth = [(k, day(k), ("HELD", "CANCELLED", None)[k % 3], day(k) if k % 4 else None, "20:00", k, None if k % 5 == 0 else "Hall") for k in range(24)]
    truth += [truth[1], (4, day(4), "CANCELLED", day(4), "21:00", 9, "Hall")]
    said = ("VERIFIED", "CANCELLED", "POSSIBLE", None)
    yes = (True, False, None)
    found = [(k % 26, day(k % 26 + (k % 17 == 0)), said[k % 4], day(k % 26), "20:00", k % 26 + (k % 7 == 0), " hall" if k % 3 else None, yes[k % 3], yes[k % 2], yes[k // 26]) for k in range(78)]
    a = spark.createDataFrame(truth, "gt_id long, day date, status string, g_date date, g_time string, g_fee long, g_venue string")
    b = spark.createDataFrame(found, "gt_id long, day date, status string, f_date date, f_time string, f_fee long, f_venue string, touched boolean, hallucinated boolean, cancel_miss boolean")
    normal = lambda v: "" if v is None else str(v).strip().lower()
    want = {}
    for key in {t[:2] for t in truth}:
        gs, mine = [t for t in truth if t[:2] == key], [f for f in found if f[:2] == key]
        pairs_ = [(g, f, [normal(x) == normal(y) for x, y in zip(g[3:7], f[3:7], strict=True)]) for g in gs for f in mine]
        seen = [(g, same) for g, f, same in pairs_ if f[2] == "VERIFIED"]
        missed = any(g[2] == "CANCELLED" for g in gs) and all(f[2] != "CANCELLED" for f in mine)
        row = [1, any(f[2] for f in mine), len(seen), sum(g[2] == "HELD" and all(same) for g, same in seen), *[sum(same[n] for _, same in seen) for n in range(4)], *[sum(bool(f[n]) for _, f, _ in pairs_) for n in (7, 8)], sum(bool(f[9]) for _, f, _ in pairs_) + missed]
        want[key[1]] = [x + y for x, y in zip(want.get(key[1], [0] * 11), row, strict=True)]
    with_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {c: spark.conf.get(c) for c in with_}
    try:
        for c, v in with_.items():
            spark.conf.set(c, v)
        days = validation.compared(a, b)
        plan = days._jdf.queryExecution().executedPlan().toString()
        assert {r["day"]: list(r)[1:12] for r in days.collect()} == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    # each side of the join, and not the joined rows again; a row brings its fields only where they are compared
    assert plan.count(" Sort [") == 2
    assert {r["read"] is None for r in validation._marked(b.filter("status is null or status <> 'VERIFIED'")).collect()} == {True}


def test_words_prove_only_beside_what_they_need(spark):
    published = F.lit("2024-05-01").cast("date")
    told = lambda title, body: one(spark, t=title, b=body).select(announcements.evidence(F.col("t"), F.col("b"), published).alias("e")).select("e.*").first().asDict()
    assert told("news", "a social some day")["social"] is False
    assert told("news", "2024.5.3\nsocial PM 8:00~11:00")["social"] is True
    full = told("news", "2024.5.3\ndoors PM 8:00~11:00\n입장료 10,000원")
    assert full["party"] and not full["course"] and not full["recap"]
    assert not told("news", "doors PM 8:00~11:00\n입장료 10,000원")["party"]
    assert told("lesson", "8 weeks, register now")["course"]


def test_a_common_key_does_not_pair_all_with_all(spark):
    failing = spark.createDataFrame([(k, "x") for k in range(5)], "source long, key string")
    candidates = spark.createDataFrame([(k, "x", float(k % 50)) for k in range(200)], "alternative long, key string, reliability double")
    found = summaries.best_routes(failing, candidates, "key").collect()
    assert {(r["source"], r["alternative"]) for r in found} == {(k, a) for k in range(5) for a in (49, 99)}


def test_names_of_a_group_are_compared_once_and_looked_up_by_pairs(spark):
    words = [["carla"], ["carla", "b"], ["carlab"], [], ["x"]]
    rows = [(k, None if k % 11 == 0 else k % 2, words[k % 5]) for k in range(1, 41)]
    found = pairs.met(spark.createDataFrame(rows, "event_id long, day int, words array<string>"), ["day"])
    alike = {(tuple(x), tuple(y)): spark.createDataFrame([(x, y)], "x array<string>, y array<string>").select(pairs.names_match(F.col("x"), F.col("y"))).first()[0] for x in words for y in words}
    want = {(a[0], b[0]): alike[tuple(a[2]), tuple(b[2])] for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1]}
    assert {(r["a"]["event_id"], r["b"]["event_id"]): r["names"] for r in found.collect()} == want
    # no words travel with a pair
    assert "words" not in found.schema["a"].dataType.names
