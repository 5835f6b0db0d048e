"""Unresolved names: clusters by suggested place or likeness, against the reference's sequential search."""

import difflib
import random

from driftwood.functions.text import folded_key, similarity
from driftwood.operators import resolution


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def sequential(names, place):
    left, out = sorted(names), {}
    while left:
        seed = left[0]
        mine = [x for x in left if x == seed or (place.get(seed) is not None and place.get(seed) == place.get(x)) or ratio(seed, x) >= 0.82]
        out |= {x: seed for x in mine}
        left = [x for x in left if x not in mine]
    return out


def some_names():
    rnd = random.Random(11)
    out = set()
    for _ in range(25):
        base = [rnd.choice("abcdeko") for _ in range(rnd.randrange(1, 16))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randrange(2)] = rnd.choice(["x", "e", "ab", ""])
                copy = copy or ["z"]
            out.add("".join(copy))
    return sorted(out)


def test_alike_names_are_all_pairs(spark):
    names = some_names()
    found = {(r["a"], r["b"]) for r in resolution.alike_names(spark.createDataFrame([(x,) for x in names], "name string"), similarity).collect()}
    want = {(a, b) for a in names for b in names if a < b and ratio(a, b) >= 0.82}
    assert found == want | {(b, a) for a, b in want} and len(want) > 50


def test_clusters_match_the_sequential_search(spark):
    names = some_names()
    place = {x: len(x) for k, x in enumerate(names) if k % 5 == 0}
    links = resolution.alike_names(spark.createDataFrame([(x,) for x in names], "name string"), similarity)
    rows = spark.createDataFrame([(x, place.get(x)) for x in names], "name string, place long")
    assert {r["name"]: r["seed"] for r in resolution.unresolved_clusters(rows, links).collect()} == sequential(names, place)


def test_names_that_differ_early_meet_and_strangers_do_not(spark):
    texts = spark.createDataFrame([(x,) for x in ("The El Tango", "El Tango Bar", "ElTango Bar (2F)", "The Ballroom Of Kings", "Casa Milonga", "Milonga Casa")], "text string")
    places = spark.createDataFrame([(1, "Casa Milonga")], "place long, alias string")
    seeds = {r["text"]: r["seed"] for r in resolution.clustered(texts, places, folded_key, similarity).collect()}
    assert seeds["El Tango Bar"] == seeds["ElTango Bar (2F)"] and seeds["The El Tango"] != seeds["The Ballroom Of Kings"] and len(seeds) == 6
