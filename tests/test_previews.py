"""A preview of touched keys against the difference of two full computations."""

import datetime as dt
import random

from driftwood.operators import duplicates, previews

EVENT = "event_id long, event_date date, venue_id string, venue_text string, start_min int, name_key string, metro string"


def made(seed):
    rnd = random.Random(seed)
    day = lambda: rnd.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    return [(k, day(), rnd.choice([None, "v1", "v2", "v3"]), rnd.choice(["hall", "club", "bar", None]), rnd.choice([None, 600, 1200]), rnd.choice(["a", "b", None]), rnd.choice([None, None, "north", "south"])) for k in range(70)]


def full(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def difference(before, after):
    return {k: (before.get(k), after.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


def test_previews_equal_full_recomputation(spark):
    cases = [(2, [("hall", "v2", "north"), ("club", "v3", None)], True), (3, [("nowhere", "v1", None)], False)]
    for seed, linked, told in cases:
        events = spark.createDataFrame(made(seed), EVENT)
        links = spark.createDataFrame(linked, "venue_text string, venue_id string, metro string")
        rnd = random.Random(seed)
        blocked = spark.createDataFrame([tuple(sorted(rnd.sample(range(70), 2))) for _ in range(150)], "event_id long, other_id long").distinct()
        then = previews.overlaid(events, links)
        assert then.count() == 70
        for apart in [blocked if told else None]:
            pairs, folds = previews.previewed(events, links, apart)
            got = {(r["event_id"], r["other_id"]): (r["before"], r["after"]) for r in pairs.collect()}
            assert got == difference(full(duplicates.pairs(events), ("event_id", "other_id"), "rule"), full(duplicates.pairs(then), ("event_id", "other_id"), "rule"))
            got_folds = {(r["event_id"],): (r["before"], r["after"]) for r in folds.collect()}
            assert got_folds == difference(full(duplicates.folded(events, apart), ("event_id",), "canonical_id"), full(duplicates.folded(then, apart), ("event_id",), "canonical_id"))
            assert bool(got) == (seed < 3)


def test_pairs_are_not_shuffled(spark):
    events = spark.createDataFrame([(k, dt.date(2024, 1, 1), None if k % 2 else "v1", "hall", 600, "a", None) for k in range(300)], EVENT)
    links = spark.createDataFrame([("hall", "v1", None)], "venue_text string, venue_id string, metro string")
    found = previews.previewed(events, links)[0]
    assert {tuple(r)[2:] for r in found.collect()} == {("REVIEW", "AUTO")} and found.count() == 300 * 299 // 2 - 150 * 149 // 2
    assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
