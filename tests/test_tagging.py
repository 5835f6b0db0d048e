"""Terms in texts against a plain reading: one pattern for each term, then the longest hits first."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from driftwood.operators import tagging

TERM = "term_id long, term string, formats array<string>, enabled boolean, genre string"
TEXT = "key long, text string, genre string, term string"
ORDER = ("EVENING", "PRACTICE", "GENERAL", "SOCIAL")


def norm(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).strip().lower()


def spans(term, text):
    if not term or not text:
        return []
    edge = (r"(?<![a-z0-9])", r"(?![a-z0-9])") if term.isascii() else ("", "")
    return [(m.start(), m.end()) for m in re.finditer(edge[0] + re.escape(term) + edge[1], text)]


def ordered(formats):
    return [f for f in ORDER if f in formats] + sorted(set(formats) - set(ORDER))


def resolve(text, genre, terms):
    hits = []
    for term_id, term, formats, enabled, of in terms:
        if enabled and formats and (genre is None or of == genre):
            hits += [(a, b, norm(term), term_id, term, formats) for a, b in spans(norm(term), norm(text))]
    hits.sort(key=lambda h: (h[0] - h[1], h[0], h[2], h[3]))
    chosen = []
    for h in hits:
        if not any(h[0] < c[1] and c[0] < h[1] for c in chosen):
            chosen.append(h)
    once = {}
    for h in sorted(chosen, key=lambda h: h[0]):
        once.setdefault(h[3], h)
    return (chosen[0][4] if chosen else None, [h[4] for h in once.values()], ordered({f for h in once.values() for f in h[5]}), list(once))


def example(seed=1):
    rnd = random.Random(seed)
    words = ["the", "nation", "building", "the nation", "nation building", "밤", "밤무대", "무대", "t", "the the", "Ｔｈｅ", "a-b", "café", "x1"]
    terms = [(k, w, rnd.choice([["EVENING"], ["PRACTICE", "EVENING"], ["WALK", "SOCIAL"], ["ZOO"]]), True, rnd.choice([None, "en", "kr"])) for k, w in enumerate(words)]
    terms += [(50, "nation", ["SOCIAL"], True, "en"), (51, "building", ["SOCIAL"], False, "en"), (52, "hall", [], True, "en"), (53, None, ["SOCIAL"], True, "en"), (54, "  ", ["SOCIAL"], True, "en")]
    texts = [" ".join(rnd.choice([*words, "other", "밤밤무대밤", "xthe", "1building", "nation's", "the\tnation"]) for _ in range(rnd.randrange(1, 25))) for _ in range(150)]
    texts += [None, "", " \n", "the nation building", "the " * 3000, "밤" * 5000, "Ｔｈｅ　ＮＡＴＩＯＮ building"]
    return [(k, t, rnd.choice([None, "en", "kr", "xx"]), "clash") for k, t in enumerate(texts)], terms


def found(spark, texts, terms, **more):
    rows = tagging.tagged(spark.createDataFrame(texts, TEXT), spark.createDataFrame(terms, TERM), ORDER, **more).collect()
    return {r["key"]: (r["term"], r["terms"], r["formats"], r["term_ids"]) for r in rows}


def test_terms_match_a_plain_reading(spark):
    texts, terms = example()
    want = {k: resolve(t, g, terms) for k, t, g, _ in texts}
    assert found(spark, texts, terms) == want
    assert sum(bool(w[1]) for w in want.values()) > 60


def test_a_table_beyond_one_automaton_gives_the_same(spark):
    texts, terms = example(2)
    assert found(spark, texts, terms, most_letters=60) == {k: resolve(t, g, terms) for k, t, g, _ in texts}


def test_the_longest_of_overlapping_terms_stays(spark):
    terms = [(1, "the nation", ["A"], True, None), (2, "nation building", ["B"], True, None)]
    assert found(spark, [(1, "on the nation building", None, "")], terms)[1][1] == ["nation building"]


def test_no_terms_and_no_texts(spark):
    texts, terms = example()
    assert set(map(str, found(spark, texts[:3], []).values())) == {str((None, [], [], []))}
    assert found(spark, [], terms) == {}


def test_occurrences_have_places_in_code_points(spark):
    texts = spark.createDataFrame([(1, "ä 밤 nation", "kept")], "key long, text string, more string")
    patterns = spark.createDataFrame([(7, "nation", None), (8, "밤", "s")], "pattern long, letters string, scope string")
    row = tagging.occurrences(texts, patterns).first()
    assert row["more"] == "kept" and [(h["start"], h["end"], h["pattern"], h["scope"]) for h in row["hits"]] == [(2, 3, 8, "s"), (4, 10, 7, None)]


KIND = "key long, event_type string, stored array<string>, text string"


def test_kinds_by_terms_then_storage_then_type(spark):
    terms = [(1, "milo", ["EVENING"], True, None), (2, "prac", ["PRACTICE"], True, None), (3, "prolo", ["EVENING", "PRACTICE"], True, None), (4, "soc", ["SOCIAL"], True, None)]
    rows = [
        (1, "evening", None, "milo tonight"),
        (2, "EVENING", None, "milo and prac"),
        (3, "EVENING", None, "prolo and milo"),
        (4, "SOCIAL", None, "milo"),
        (5, None, None, "prac"),
        (6, "EVENING", None, "prac"),
        (7, "FESTIVAL", None, "milo"),
        (8, "PARTY", ["SOCIAL", "EVENING"], "nothing"),
        (9, "PARTY", None, "nothing"),
        (10, "LECTURE", None, "nothing"),
        (11, None, None, None),
        (12, "EVENING", None, "milo soc"),
    ]
    events = spark.createDataFrame(rows, KIND)
    tags = tagging.tagged(events.select("key", "text", F.lit(None).cast("string").alias("genre")), spark.createDataFrame(terms, TERM), ORDER)
    scene = tagging.Kinds(format_labels={"SOCIAL": "Social", "UNKNOWN": "?"}, type_labels={"PARTY": "Party", "LECTURE": "Lecture"})
    got = {r["key"]: (r["display"], r["kind_formats"], r["certainty"], r["uncertain"], r["reasons"]) for r in tagging.kinds(events.select("key", "event_type", "stored").join(tags, "key"), scene).collect()}
    assert got == {
        1: ("milo", ["EVENING"], "CONFIRMED", False, ["TERM_MATCH milo"]),
        2: ("milo · prac", ["EVENING", "PRACTICE"], "AMBIGUOUS", True, ["TERM_MATCH milo", "TERM_MATCH prac", "TERMS_DISAGREE", "NO_MIXED_TERM"]),
        3: ("prolo", ["EVENING", "PRACTICE"], "CONFIRMED", False, ["TERM_MATCH prolo", "TERM_MATCH milo"]),
        4: ("milo", ["EVENING"], "AMBIGUOUS", True, ["TERM_MATCH milo", "ENGINE_DISAGREES"]),
        5: ("prac", ["PRACTICE"], "CONFIRMED", False, ["TERM_MATCH prac"]),
        6: ("prac", ["PRACTICE"], "CONFIRMED", False, ["TERM_MATCH prac"]),
        7: ("FESTIVAL", [], "ENGINE", False, ["ENGINE_TYPE"]),
        8: ("EVENING + Social", ["EVENING", "SOCIAL"], "STORED", False, ["STORED_FORMATS"]),
        9: ("Party", ["SOCIAL"], "ENGINE", False, ["NO_TERM", "ENGINE_TYPE"]),
        10: ("Lecture", [], "UNRESOLVED", True, ["NO_TERM", "ENGINE_NOT_A_FORMAT"]),
        11: ("?", [], "UNRESOLVED", True, ["NO_TERM", "ENGINE_NONE"]),
        12: ("milo · soc", ["EVENING", "SOCIAL"], "AMBIGUOUS", True, ["TERM_MATCH milo", "TERM_MATCH soc", "TERMS_DISAGREE", "NO_MIXED_TERM"]),
    }


def test_hits_are_held_for_some_texts_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": list(range(7)), "text": ["ab", None, "abc", "", "밤" * 9, "a", "b"], "hits": [[1], None, [1, 2, 3], [], [4] * 9, [5], [6]]})
    for weigh, most in (("text", 5), ("hits", 3)):
        some = list(tagging.pieces(batch, weigh, most))
        assert pa.Table.from_batches(some).to_pydict() == batch.to_pydict()
        assert len(some) > 2 and all(b.num_rows == 1 or sum(len(x or "") for x in b.column(weigh).to_pylist()) <= most for b in some)
    assert list(tagging.pieces(batch.slice(0, 0))) == []


def test_a_term_of_a_text_leaves_its_task_once(spark):
    texts = spark.createDataFrame([(1, "the nation " * 500, "en")], "key long, text string, of string")
    patterns = spark.createDataFrame([(7, "the", None), (8, "nation", "en"), (9, "the", "en")], "pattern long, letters string, scope string")
    for more in ({}, {"most_letters": 20}):
        row = tagging.chosen_terms(texts, patterns, **more).first()
        assert sorted((c["pattern"], c["start"]) for c in row["chosen"]) == [(8, 4), (9, 0)]
        assert min(row["chosen"], key=lambda c: c["rank"])["pattern"] == 8
