"""Micro fixtures for the semantics that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwood.operators import announcements, duplicates, graphs, incremental, metrics, resolution, search, streaks, supply
from driftwood.functions.text import folded_key, similarity
from driftwood.sources import pages

D = dt.date
EVENT = "event_id long, event_date date, end_date date, start_min int, genre string, region string, status string, tier string, canonical_id long"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, D(2026, 9, 1), D(2026, 9, 5), 600, "A", "R", "VERIFIED", "PRIMARY", None),
        (2, D(2026, 9, 4), None, None, "B", "R", "VERIFIED", "OTHER", None),
        (3, D(2026, 9, 4), None, 1200, None, None, None, "OFFICIAL", None),
        (4, D(2026, 9, 4), None, 60, "A", "R", "CANCELLED", "PRIMARY", None),
        (5, D(2026, 9, 4), None, 60, "A", "R", "VERIFIED", "PRIMARY", 1),
        (6, D(2026, 9, 7), None, 60, "A", "R", "COMPLETED", "PRIMARY", None),
    ]
    return spark.createDataFrame(rows, EVENT)


def ids(df):
    return [r["event_id"] for r in df.collect()]


def test_search_takes_periods_that_overlap_and_orders_null_clocks_last(events):
    found = search.matching(events, D(2026, 9, 4), D(2026, 9, 4))
    assert ids(search.page(found, 10, 0)) == [1, 3, 2]


def test_no_filter_is_everything_and_an_empty_one_nothing(events):
    window = D(2026, 9, 1), D(2026, 9, 30)
    assert len(ids(search.matching(events, *window))) == 3
    assert ids(search.matching(events, *window, genres=[])) == []
    assert ids(search.matching(events, *window, statuses=["CANCELLED"])) == [4]


def test_further_genres_match_without_fanning_out(spark, events):
    more = spark.createDataFrame([(2, "A"), (2, "A"), (2, "C")], "event_id long, genre string")
    found = search.matching(events, D(2026, 9, 1), D(2026, 9, 30), genres=["A"], more_genres=more)
    assert sorted(ids(found)) == [1, 2]
    assert {r["genre"]: r["n"] for r in search.facet(found, "genre").collect()} == {"A": 1, "B": 1}


def test_calendar_counts_each_day_and_fills_zeros(events):
    days = {r["day"].day: r["n"] for r in search.calendar(events, D(2026, 9, 3), D(2026, 9, 8)).collect()}
    assert days == {3: 1, 4: 3, 5: 1, 6: 0, 7: 1, 8: 0}


def test_streak_counts_partial_runs_as_failures(spark):
    log = spark.createDataFrame([("a", 1, "OK"), ("a", 2, "FAILED"), ("a", 3, "PARTIAL"), ("b", 1, "FAILED"), ("b", 2, "OK"), ("c", 1, "FAILED")], "s string, n int, status string")
    found = streaks.failure_streak(log, "s", [F.desc("n")], F.col("status") == "OK")
    assert {r["s"]: r["streak"] for r in found.collect()} == {"a": 2, "b": 0, "c": 1}


DUP = "event_id long, event_date date, venue_id string, venue_text string, start_min int, name_key string, metro string, is_root boolean"


def dup(spark, *rows):
    return spark.createDataFrame([(i, D(2026, 9, 4), v, t, c, n, m, r) for i, v, t, c, n, m, r in rows], DUP)


def test_missing_clocks_are_not_equal(spark):
    e = dup(spark, (1, "V", None, None, "x", None, False), (2, "V", None, None, "x", None, False))
    assert [r["rule"] for r in duplicates.pairs(e).collect()] == ["REVIEW"]
    assert duplicates.folded(e).collect() == []


def test_contradicting_metros_go_to_review(spark):
    e = dup(spark, (1, "V", None, 60, "x", "seoul", False), (2, "V", None, 60, "x", "busan", False), (3, "V", None, 60, "x", None, False))
    assert {(r["event_id"], r["other_id"]): r["rule"] for r in duplicates.pairs(e).collect()} == {(1, 2): "REVIEW", (1, 3): "AUTO", (2, 3): "AUTO"}
    assert {r["event_id"]: r["canonical_id"] for r in duplicates.folded(e).collect()} == {3: 1}


def test_an_existing_root_with_a_higher_id_stays(spark):
    e = dup(spark, (1, "V", None, 60, "x", None, False), (2, "V", None, 60, "x", None, True))
    assert {r["event_id"]: r["canonical_id"] for r in duplicates.folded(e).collect()} == {1: 2}


def test_pairs_told_apart_by_a_person_do_not_fold(spark):
    e = dup(spark, (1, "V", None, 60, "x", None, False), (2, "V", None, 60, "x", None, False), (3, "V", None, 60, "x", None, False))
    apart = spark.createDataFrame([(1, 2)], "event_id long, other_id long")
    assert {r["event_id"]: r["canonical_id"] for r in duplicates.folded(e, apart).collect()} == {3: 1}


def test_folding_again_changes_nothing(spark):
    e = dup(spark, *[(i, f"V{i % 3}", None, 60 * (i % 2), "x", None, False) for i in range(1, 30)])
    gone = {r["event_id"] for r in duplicates.folded(e).collect()}
    assert duplicates.folded(e.filter(~F.col("event_id").isin(*gone))).collect() == []


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in graphs.components(chain).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_cliques_are_greedy_by_id(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 1, 4), ("g", 2, 4)], "g string, a long, b long")
    assert sorted(r["member"] for r in duplicates.greedy_clique(edges, "g").collect()) == [1, 2, 4]


def test_identity_tiers_leave_ambiguous_keys(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "id long, k1 string, k2 string")
    new = spark.createDataFrame([(11, "a", "x"), (12, "b", "y"), (13, None, "w")], "id long, k1 string, k2 string")
    found = incremental.matched_identities(old, new, "id", [["k1"], ["k2"]])
    assert sorted(tuple(r) for r in found.collect()) == [(1, 11, 2), (2, 12, 2)]


def test_corrections_tell_null_from_absent(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, s string, n int")
    fixes = spark.createDataFrame([(1, "s", None, 2), (1, "s", "old", 1), (2, "n", "7", 1)], "k long, field string, value string, at int")
    assert sorted(map(tuple, announcements.corrected(rows, fixes, "k", ["s", "n"]).collect())) == [(1, None, 5), (2, "b", 7)]


def test_schedules_give_one_candidate_a_day(spark):
    body = "2026.9.18 PM 8:00~11:00 milonga\n입장료 10,000원\n장소: Studio A\n2026.9.19 PM 9:00~11:30 milonga\n2026.9.19 milonga again"
    posts = spark.createDataFrame([(1, "September milongas", body, D(2026, 9, 1), None)], "post_id long, title string, body string, published date, known_kind string")
    got = sorted((r["event_date"], r["start_min"], r["venue"]) for r in announcements.candidates(posts).collect())
    assert got == [(D(2026, 9, 18), 1200, "Studio A"), (D(2026, 9, 19), 1260, "Studio A")]


def test_alias_attempts_and_suggestions(spark):
    places = spark.createDataFrame([(1, "Tango Bar"), (2, "Tango-Bar!"), (3, "Studio Ocho"), (3, "Ocho")], "place long, alias string")
    asked = spark.createDataFrame([(1, ["tango bar", "OCHO"]), (2, ["nowhere"])], "id long, attempts array<string>")
    assert {r["id"]: r["place"] for r in resolution.resolved(asked, "id", "attempts", places, folded_key).collect()} == {1: 3, 2: None}
    like = resolution.suggestions(spark.createDataFrame([(7, "Studio Ochо2")], "id long, t string"), "id", "t", places, folded_key, similarity, 3).collect()
    assert like[0]["place"] == 3 and like[0]["confidence"] in ("MEDIUM", "HIGH")


def test_grid_and_rules(spark):
    rows = spark.createDataFrame([("a", "x")], "g string, r string")
    axes = spark.createDataFrame([("a",), ("b",)], "g string"), spark.createDataFrame([("x",), ("y",)], "r string")
    assert sorted(map(tuple, metrics.dense_grid(rows, ("g", "r"), axes).collect())) == [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0)]
    assert [r["n"] for r in metrics.violations(rows, {"never": F.lit(None).cast("boolean"), "always": F.lit(False)}).collect()] == [0, 1]


def test_page_parsers(spark):
    html = """<script type="application/ld+json">{"@type":"Event","name":"Milonga","startDate":"2026-09-18","location":{"name":"Bar"}}</script><script type="application/ld+json">{broken</script>"""
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [tuple(r) for r in pages.json_ld(frame).collect()] == [(1, "Milonga", "2026-09-18", None, "Bar")]
    site = spark.createDataFrame([("<urlset><url><loc> http://a/?x=1&amp;y=2 </loc></url></urlset>",)], "xml string")
    assert pages.sitemap(site).first()["loc"] == "http://a/?x=1&y=2"
    payload = ['{"documents":[{"cafename":"C","contents":"<b>x</b> y","datetime":"2026-09-18T10:00:00+09:00","title":"T","url":"http://u"}]}', '{"items":[{"title":"S","link":"http://v","description":"d","bloggername":"B","postdate":"20260919"}]}']
    got = pages.search_payload(spark.createDataFrame([(p,) for p in payload], "payload string"))
    assert sorted(map(tuple, got.collect())) == [("S", "http://v", "d", "B", D(2026, 9, 19)), ("T", "http://u", "x y", "C", D(2026, 9, 18))]
    assert pages.within_bounds(got, ["HTTP://V"], []).count() == 1 and pages.within_bounds(got, [], []).count() == 2


def test_robots_longest_match_and_end_mark(spark):
    rules = spark.createDataFrame([("h", False, "/a"), ("h", True, "/a/b"), ("h", False, "/*.gif$"), ("h", False, "")], "host string, allow boolean, path string")
    urls = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/i.gif"), ("h", "/i.gif?x"), ("z", "/a")], "host string, target string")
    assert {r["target"] + r["host"]: r["allowed"] for r in pages.robots_allowed(rules, urls).collect()} == {"/a/xh": False, "/a/b/ch": True, "/i.gifh": False, "/i.gif?xh": True, "/az": True}


def test_import_errors(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (None, "f")], "k long, v string")
    old = spark.createDataFrame([(2, "c"), (3, "x")], "k long, v string")
    assert {r["k"]: r["action"] for r in pages.csv_changes(new, old, "k", ["v"]).collect()} == {1: "ERROR", 2: "SKIP", 3: "UPDATE", 4: "CREATE", None: "ERROR"}


def test_festivals_programmes_weeklies(spark):
    schema = "post_id long, title string, body string, published date"
    posts = spark.createDataFrame(
        [
            (1, "Tango week", "2026.10.30 ~ 11.1 everywhere", D(2026, 9, 1)),
            (2, "Backwards", "2026.10.30 ~ 10.1", D(2026, 9, 1)),
            (3, "Night", "2026.10.3\nBeginner workshop PM 6:00~7:00\nMilonga: PM 8:00~1:00\n문의 010", D(2026, 9, 1)),
            (4, "Weekly", "금: PM 8:00~11:00\n토요일: 휴무\n(일) : PM 7:00~10:00", D(2026, 9, 16)),
            (5, "All off", "금: 휴무", D(2026, 9, 16)),
        ],
        schema,
    )
    assert sorted((r["post_id"], r["night"]) for r in announcements.festivals(posts).collect()) == [(1, D(2026, 10, 30)), (1, D(2026, 10, 31)), (1, D(2026, 11, 1))]
    got = [tuple(r)[2:] for r in announcements.programmes(posts.filter("post_id = 3")).orderBy("nth").collect()]
    assert got == [("Beginner workshop", 1080, 1140, 0), ("Milonga", 1200, 60, 1)]
    assert sorted(tuple(r) for r in announcements.weekly(posts.filter("post_id > 3")).collect()) == [(4, D(2026, 9, 18), 1200, 1380), (4, D(2026, 9, 20), 1140, 1320)]


def test_images_fill_only_what_is_missing(spark):
    found = spark.createDataFrame([(1, D(2026, 9, 18), None, None, None), (2, None, 600, 5000, "Bar")], "post_id long, event_date date, start_min int, fee long, venue string")
    ocr = spark.createDataFrame([(1, "2026.9.19 PM 8:00~11:00 입장료 10,000원\n장소: Hall", D(2026, 9, 1))], "post_id long, ocr_text string, published date")
    rows = {r["post_id"]: r for r in announcements.filled_from_images(found, ocr).collect()}
    assert (rows[1]["event_date"], rows[1]["start_min"], rows[1]["fee"], rows[1]["venue"]) == (D(2026, 9, 18), 1200, 10000, "Hall")
    assert rows[1]["filled"] == "start_min,fee,venue" and rows[1]["conflicts"] == "event_date" and rows[2]["filled"] == ""


def test_long_periods_meet_short_ones_inside_them(spark):
    day = D.fromisoformat
    rows = [(1, "n", day("2024-01-01"), day("2024-06-30")), (2, "n", day("2024-06-01"), day("2024-06-03")), (3, "n", day("2024-09-30"), day("2024-09-30")), (4, "other", day("2024-06-01"), day("2024-06-03"))]
    found = duplicates.period_conflicts(spark.createDataFrame(rows, "event_id long, name_key string, first_day date, last_day date"), 20)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 0)]


def test_lineage_reaches_the_last_ancestor_and_ends_on_cycles(spark):
    links = spark.createDataFrame([(k, k - 1) for k in range(1, 12)] + [(0, None), (50, 51), (51, 52), (52, 50)], "node long, parent long")
    found = {(r["node"], r["ancestor"]): r["depth"] for r in graphs.lineage(links).collect()}
    assert {k: v for k, v in found.items() if k[0] < 50} == {(a, b): a - b for a in range(12) for b in range(a)}
    assert {k: v for k, v in found.items() if k[0] >= 50} == {(50, 51): 1, (51, 52): 1, (52, 50): 1, (50, 52): 2, (51, 50): 2, (52, 51): 2}


def test_digests_of_many_rows_do_not_overflow(spark):
    assert supply.revision_digest(spark.range(200_000), "id").first()["n"] == 200_000


def test_rows_within_a_length_are_counted_without_sliding(spark):
    import random

    from driftwood.operators import streaks

    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, 1, 2]), rnd.choice([None, rnd.randrange(-40, 40), 10 * rnd.randrange(-4, 4)])) for k in range(300)]
    found = streaks.counted_within(spark.createDataFrame(rows, "id long, host long, at long"), "host", "at", 10, "n")
    same = lambda h, t: [r for r in rows if r[1] == h and (r[2] is None if t is None else r[2] is not None and t - 10 <= r[2] <= t)]
    assert {r["id"]: r["n"] for r in found.collect()} == {k: len(same(h, t)) for k, h, t in rows}
    # no frame of the plan slides
    assert "RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_leave_their_join_without_another_shuffle(spark):
    day = D(2026, 9, 11)
    rows = [(k, day, "V" if k % 3 else None, "V", 1200 if k % 4 else None, "k" if k % 2 else "n", None) for k in range(1, 13)]
    found = duplicates.pairs(spark.createDataFrame(rows, "event_id long, event_date date, venue_id string, venue_text string, start_min int, name_key string, metro string"))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        assert (r["event_id"], r["other_id"]) not in got
        got[r["event_id"], r["other_id"]] = r["rule"]
    want = {}
    for a in rows:
        for b in rows:
            place, clock = a[2] is not None and a[2] == b[2], a[4] is not None and a[4] == b[4]
            if a[0] < b[0] and (place or (clock and a[5] == b[5]) or (clock and a[2] is None and b[2] is None)):
                want[a[0], b[0]] = "AUTO" if place and clock else "REVIEW"
    assert got == want


def test_lineage_of_nodes_with_one_parent_is_grouped_in_no_round(spark):
    links = spark.createDataFrame([(k, k // 2) for k in range(1, 200)], "node long, parent long")
    found = graphs.lineage(links)
    # the table is the rounds' parts, not one that was written anew
    assert len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) > 1
    got = sorted((r["node"], r["ancestor"], r["depth"]) for r in found.collect())
    assert got == sorted((k, k >> d, d) for k in range(1, 200) for d in range(1, k.bit_length() + 1))


def test_lineage_with_several_parents_and_lines_into_cycles_keeps_the_shortest_way(spark):
    forks = [(k, k + 1) for k in range(1, 9)] + [(1, 4), (2, 7)]
    into_cycle = [(20, 21), (21, 22), (22, 23), (23, 24), (24, 22), (30, 30), (31, 30)]
    for edges in (into_cycle, forks + into_cycle):
        want = {}
        for start in {a for a, _ in edges}:
            level, depth = {start}, 0
            while level:
                depth += 1
                level = {b for a, b in edges if a in level and a != b and b != start and (start, b) not in want}
                want |= {(start, b): depth for b in level}
        found = graphs.lineage(spark.createDataFrame(edges, "node long, parent long"))
        assert sorted((r["node"], r["ancestor"], r["depth"]) for r in found.collect()) == sorted((a, b, d) for (a, b), d in want.items())


def test_null_keys_are_synced_like_any_other(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "k int, f string")
    found = incremental.synced(side((1, "a"), (2, None), (None, None), (3, "c"), (3, "c")), side((1, "a"), (1, "a"), (2, None), (None, "n"), (4, "d")), ["k", "f"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(None, None, "DELETE"), (3, "c", "DELETE"), (None, "n", "INSERT"), (4, "d", "INSERT")], key=repr)


def test_texts_are_dealt_out_before_they_meet_places(spark):
    from driftwood.operators import summaries

    texts = spark.createDataFrame([(1, "at Hall 1!", 0, 0), (2, "hall12", 1, 1), (3, None, 0, 0)], "text_id long, text string, region int, genre int").coalesce(1)
    places = spark.createDataFrame([(7, "Hall 1", 0, 5), (8, "Hall 12", 5, 5)], "place long, name string, p_region int, p_genre int")
    found = summaries.mentions(texts, places)
    assert sorted(map(tuple, found.collect())) == [(1, 7, True), (2, 7, False), (2, 8, False)]
    assert "RepartitionByExpression [key" in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_read_once_by_explodes(spark):
    posts = spark.createDataFrame([(1, "Tango PM 3:00~4:30\nno clock\nSalsa 20:00 - 23:30"), (2, "nothing"), (3, None)], "post_id long, body string")
    found = announcements.programmes(posts)
    assert sorted((r["post_id"], r["nth"], r["name"], r["start_min"], r["end_min"]) for r in found.collect()) == [(1, 0, "Tango", 900, 990), (1, 1, "Salsa", 1200, 1410)]
    assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()
