"""Labels in context, snapshots and recovery against plain readings."""

import datetime as dt
import difflib
import random
import tempfile

from pyspark.sql import functions as F

from driftwood.functions.text import similarity
from driftwood.operators import contexts, recovery, snapshots

WORD = "label string, role string, rank int, word string"


def plain_labels(text, words, around):
    lowered = (text or "").lower()
    context = any(w.lower() in lowered for _, role, _, w in words if role == "CONTEXT" and w)
    out = []
    for label in sorted({w[0] for w in words if w[1] == "WORD"}):
        own = [w for _, _, w in sorted((r, k, w) for k, (la, role, r, w) in enumerate(words) if la == label and role == "WORD" and w)]
        negatives = [w for _, _, w in sorted((r, k, w) for k, (la, role, r, w) in enumerate(words) if la == label and role == "NEGATIVE" and w)]
        clean = wrapped = None
        for word in own:
            at = lowered.find(word.lower())
            while at >= 0 and clean is None:
                window = lowered[max(0, at - around) : at + len(word) + around]
                near = next((n for n in negatives if n.lower() in window), None)
                if near is None:
                    clean = word
                else:
                    wrapped = wrapped or (word, near)
                at = lowered.find(word.lower(), at + 1)
            if clean:
                break
        if clean and not context:
            near = next((n for n in negatives if n.lower() in lowered), None)
            if near:
                clean, wrapped = None, (clean, near)
        if clean:
            out.append((label, clean, None))
        elif wrapped:
            out.append((label, *wrapped))
    return out


def test_labels_match_a_plain_reading(spark):
    rnd = random.Random(5)
    words = [("swing", "WORD", 0, "Swing"), ("swing", "WORD", 1, "lindy"), ("swing", "NEGATIVE", 0, "stock"), ("swing", "NEGATIVE", 1, "golf"), ("salsa", "WORD", 0, "salsa"), ("salsa", "WORD", 1, "aa"), ("salsa", "NEGATIVE", 0, "sauce"), ("any", "CONTEXT", 0, "club"), ("tango", "WORD", 0, "탱고"), ("tango", "NEGATIVE", 0, "망고"), ("tango", "WORD", 2, "")]
    pieces = ["swing", "SWING", "lindy", "stock", "golf", "salsa", "sauce", "aaaa", "탱고", "망고", "club", "x", "some words", "another long word here"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", "  ", " - ", "........."]) for _ in range(rnd.randrange(1, 14))) for _ in range(200)] + [None, "", "swing " * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {}
    for r in contexts.labels_in_context(frame, spark.createDataFrame(words, WORD), 8).collect():
        got.setdefault(r["key"], []).append((r["label"], r["word"], r["cancelled_by"]))
    want = {k: found for k, t in enumerate(texts) if (found := plain_labels(t, words, 8))}
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert {c is None for v in want.values() for _, _, c in v} == {True, False}


def test_a_changed_row_is_found_in_its_bucket(spark):
    kept = snapshots.Snapshots(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), ["id"], 4)
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("s"))
    assert kept.write(rows, "2024-01-01") and not kept.write(rows.filter("id < 5"), "2024-01-01")
    assert kept.rows("2024-01-01").count() == 500 and kept.verify("2024-01-01").isEmpty()
    # neither order nor partitions matter; a null is no empty text; a row more or twice is seen
    assert kept.changed("2024-01-01", rows.orderBy(F.desc("v")).repartition(7)).isEmpty()
    leaf = lambda n: rows.filter(F.col("id") == n).select(F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).first()[0]
    for other, where in (
        (rows.withColumn("v", F.when(F.col("id") == 77, 100).otherwise(F.col("v"))), 77),
        (rows.withColumn("s", F.when(F.col("id") == 9, "").otherwise(F.col("s"))), 9),
        (rows.unionAll(rows.filter("id = 40")), 40),
        (rows.filter("id <> 200"), 200),
    ):
        assert [r["leaf"] for r in kept.changed("2024-01-01", other).collect()] == [leaf(where)]
    # files that were tampered with no longer fit the tree
    rows.filter("id = 77").write.mode("append").parquet(f"{kept.folder}/rows/day=2024-01-01")
    assert [r["leaf"] for r in kept.verify("2024-01-01").collect()] == [leaf(77)]
    roots = [r["digest"] for r in snapshots.tree(snapshots.leaves(rows, ["id"], 4), 4).filter("level = 0").collect()]
    assert roots == [r["digest"] for r in kept.kept_tree("2024-01-01").filter("level = 0").collect()] and len(roots) == 1


SIDE = "id long, event_date date, venue_key string, name string, start_min int, fee double"


def made_sides(seed=1):
    rnd = random.Random(seed)
    days = [None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    row = lambda k: (k, rnd.choice(days), rnd.choice(["hall", "club", "", None]), rnd.choice(["friday night", "friday nite", "friday", "jam", "friday night jam"]), rnd.choice([None, 1200]), rnd.choice([None, 10.0]))
    return [row(k) for k in range(30)], [row(100 + k) for k in range(30)]


def plain_match(a, b):
    if not (a[1] and b[1]) or a[1] != b[1]:
        return None
    placed = bool(a[2] and b[2])
    if placed and a[2] != b[2]:
        return None
    like = difflib.SequenceMatcher(None, a[3], b[3]).ratio()
    return (0.9, like) if like >= 0.72 else (0.8, like) if placed and like >= 0.45 else None


def test_matches_are_one_to_one_best_first_and_fill_what_is_missing(spark):
    for seed in (1, 2):
        left, right = made_sides(seed)
        pairs = {(a[0], b[0]): m for a in left for b in right if (m := plain_match(a, b))}
        wanted, found = spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)
        met = recovery.candidate_matches(wanted, found, similarity)
        assert {(r["want_id"], r["found_id"]): (r["score"], r["likeness"]) for r in met.collect()} == pairs and met.count() == len(pairs)
        greedy, used = {}, set()
        for (a, b), m in sorted(pairs.items(), key=lambda p: (-p[1][0], -p[1][1], p[0])):
            if not {a, b} & used:
                greedy[a] = b
                used |= {a, b}
        chosen = recovery.one_to_one(met.repartition(3), "want_id", "found_id", ["score", "likeness"])
        assert {r["want_id"]: r["found_id"] for r in chosen.collect()} == greedy and 3 < len(greedy)
        by_id = {r[0]: r for r in right}
        got = {r["id"]: (r["start_min"], r["fee"], r["matches"], r["status"]) for r in recovery.recovered(wanted, chosen, found, ["event_date", "start_min", "fee"], ["event_date", "start_min", "fee"]).collect()}
        for a in left:
            other = by_id.get(greedy.get(a[0]))
            start, fee = (a[k] if a[k] is not None or other is None else other[k] for k in (4, 5))
            status = "PENDING" if other is None else "VERIFIED" if start is not None and fee is not None else "POSSIBLE"
            assert got[a[0]] == (start, fee, int(other is not None), status)


def test_verdicts_on_pairs(spark):
    rows = [(None, "hall", "a"), (dt.date(2024, 1, 1), "hall", "friday night"), (dt.date(2024, 1, 2), "hall", "friday night"), (dt.date(2024, 1, 1), "club", "friday night"), (dt.date(2024, 1, 1), None, "zzz")]
    side = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, event_date date, venue_key string, name string")
    met = side.alias("a").join(side.alias("b"), F.col("a.id") == 1).select("b.id", recovery.same_event("a", "b", similarity).alias("v"))
    assert {r["id"]: (r["v"]["match"], r["v"]["review"], r["v"]["reasons"][0]) for r in met.collect()} == {0: (False, True, "DATE_MISSING"), 1: (True, False, "DATE_MATCH"), 2: (False, False, "DATE_MISMATCH"), 3: (False, False, "VENUE_MISMATCH"), 4: (False, True, "DATE_MATCH")}


def test_contexts_are_judged_for_some_texts_at_a_time():
    import pyarrow as pa

    from driftwood.operators import contexts, tagging

    hits = pa.array([[{"start": i, "end": i + 2, "pattern": 0, "scope": None} for i in range(tagging.HELD_HITS // 2)]] * 5, tagging._HITS)
    types = pa.schema([("key", pa.int64()), *((c, pa.string()) for c in ("label", "word", "cancelled_by"))])
    run = contexts._judged({0: ("en", contexts.WORD, 0, "th")}, 8, types)
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), hits], ["key", "hits"])])))
    assert len(out) == 3 and pa.Table.from_batches(out).to_pydict() == {"key": [0, 1, 2, 3, 4], "label": ["en"] * 5, "word": ["th"] * 5, "cancelled_by": [None] * 5}


def test_matches_of_classes_are_those_of_all_pairs(spark):
    rnd = random.Random(7)
    for placed in (True, False):
        places = ["hall", "club"] if placed else ["hall", "club", "", None]
        row = lambda k: (k, rnd.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)]), rnd.choice(places), rnd.choice(["friday night", "friday nite", "friday", "jam", "friday night jam", None]), None, None)  # noqa: E731, B023
        wanted, found = ([row(k) for k in range(first, first + 60)] for first in (0, 40))
        wanted, found = spark.createDataFrame(wanted, SIDE), spark.createDataFrame(found, SIDE)
        want = recovery.one_to_one(recovery.candidate_matches(wanted, found, similarity), "want_id", "found_id", ["score", "likeness"])
        got = recovery.one_to_one_matches(wanted, found, similarity)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() > 20


def test_copies_are_matched_without_their_pairs(spark):
    side = lambda first: spark.range(first, first + 3000).select("id", F.lit("2024-01-01").cast("date").alias("event_date"), F.lit("hall").alias("venue_key"), F.lit("jam").alias("name"))
    got = recovery.one_to_one_matches(side(0), side(3000), similarity)
    assert got.agg(F.count("*"), F.count_if(F.col("found_id") == F.col("want_id") + 3000)).first() == (3000, 3000)
