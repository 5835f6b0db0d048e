"""The limit of near-duplicate links is an argument of the stage's operator."""

import re
from collections import Counter, defaultdict

import pytest

from driftwood.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_keep_one_holds_its_limit(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    holders = defaultdict(list)
    for i in sets:
        for s in sets[i]:
            holders[s].append(i)
    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs, percent=percent).collect()) == sorted(i for i in sets if find(i) == i)


def test_one_id_over_two_texts_is_one_document(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "alone here with five words"), (1, None), (None, a), (None, a), (5, ""), (2, a + " more")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (None, None, True)}
    assert sorted(r["n_shingles"] for r in found if r["doc_id"] == 1) == [0, 56, 56]


def test_keep_one_compares_rows(spark):
    a = " ".join(f"a{k}" for k in range(60))
    rows = [(2, a, "x"), (2, a, "x"), (None, a, "y"), (1, a + " more", "z"), (2, "unlike under one id here", "x"), (None, "only this row says so", "y"), (None, "only this row says so", "w"), (3, None, "v"), (3, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = neardup.keep_one(docs, percent=80)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in left) == [(0, "only"), (1, "a0 a"), (2, "unli"), (3, ""), (3, "")]


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIR_BLOCK", 3)
    shared = " ".join(f"s{k}" for k in range(80))
    texts = [shared + " " + " ".join(f"p{k}_{j}" for j in range(12 + k % 3)) for k in range(30)]
    texts += [t + " end" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {i: find(i) for i in range(len(sets))}
