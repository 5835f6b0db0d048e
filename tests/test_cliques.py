"""Cliques of independent sources: every start is tried, over whole ids."""

import random

from driftwood.operators import duplicates
from driftwood.plans import registered

SF = "/root/testdata/sf0.001"


def largest(edges):
    """As the reference does it: each member is a start, the first of the largest trials stays."""
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    members, best = sorted({m for p in pairs for m in p}), []
    for s in members:
        trial = []
        for x in [s, *[y for y in members if y != s]]:
            if all(frozenset((x, z)) in pairs for z in trial):
                trial.append(x)
        best = trial if len(trial) > len(best) else best
    return sorted(best)


def test_a_later_start_finds_the_larger_set(spark):
    edges = spark.createDataFrame([("g", a, b) for a, b in ((1, 2), (3, 4), (3, 5), (4, 5))], "g string, a long, b long")
    assert sorted(r["member"] for r in duplicates.greedy_clique(edges, "g").collect()) == [3, 4, 5]


def test_cliques_match_the_reference(spark):
    rnd = random.Random(5)
    groups = {g: [(rnd.randrange(12), rnd.randrange(12)) for _ in range(6 * (g or 1))] for g in (None, *range(1, 9))}
    edges = spark.createDataFrame([(g, a, b) for g, es in groups.items() for a, b in es], "g long, a long, b long")
    found = {}
    for r in duplicates.greedy_clique(edges, "g").collect():
        found.setdefault(r["g"], []).append(r["member"])
    assert {g: sorted(m) for g, m in found.items()} == {g: largest(es) for g, es in groups.items() if largest(es)}


def test_cliques_are_of_whole_orders(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_suppkey <> l_partkey")
    groups = {}
    for r in lines.select("l_orderkey", "l_suppkey", "l_partkey").collect():
        groups.setdefault(r[0], []).append((r[1], r[2]))
    found = {}
    for r in registered()["independent_cliques"][0](spark, SF).collect():
        found.setdefault(r["g"], []).append(r["member"])
    assert {g: sorted(m) for g, m in found.items()} == {g: largest(es) for g, es in groups.items()}
    assert {r["g"]: r["members"] for r in registered()["clique_members"][0](spark, SF).collect()} == {g: len(m) for g, m in found.items()}


def test_small_and_large_groups_are_searched_alike(spark):
    rnd = random.Random(9)
    groups = {g: [(rnd.choice("abcdefgh"), rnd.choice("abcdefghé")) for _ in range(4 * (g or 1))] for g in (None, *range(1, 9))}
    edges = spark.createDataFrame([(g, a, b) for g, es in groups.items() for a, b in es], "g long, a string, b string")
    for small in (0, 10, 512):
        found = {}
        for r in duplicates.greedy_clique(edges, "g", small).collect():
            found.setdefault(r["g"], []).append(r["member"])
        assert {g: sorted(m) for g, m in found.items()} == {g: largest(es) for g, es in groups.items() if largest(es)}
