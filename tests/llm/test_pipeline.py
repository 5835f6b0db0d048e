"""The pipeline's stages on the smallest table, each against a brute-force version of itself."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from driftwood.llm.common import stored
from driftwood.llm.secret_scan import base_spans

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage; a few documents that stages must drop or change are added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.first()
    more = spark.createDataFrame([(10_000, "12 34 ...", "en", "src0", 9), (10_001, None, None, None, None), (10_002, first["text"].upper(), "en", "src0", 1), (10_003, 'one two token = "abcdef0123456789" three', "en", None, 40)], docs.schema)
    docs = stored(docs.unionAll(more), "test")
    out = [("documents", docs.collect(), docs.columns)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append((name, docs.collect(), docs.columns))
    return out


def test_language_id_drops_only_what_has_no_letters(stages):
    before, after = stages[0][1], stages[1][1]
    want = {r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in after} == want and stages[1][2] == stages[0][2]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_dedup_leaves_the_first_of_each_group(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[1][1]}
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
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in stages[2][1]) == sorted(i for i in sets if find(i) == i)
    assert stages[2][2] == stages[0][2]


def test_secrets_are_cut_and_documents_stay(stages):
    before, after = ({r["doc_id"]: r for r in stages[k][1]} for k in (2, 3))
    assert before.keys() == after.keys() and stages[3][2] == stages[0][2]
    for i, r in after.items():
        spans = base_spans(before[i]["text"])
        if spans:
            assert "<SECRET>" in r["text"] and r["n_chars"] == len(r["text"])
            assert all(s[3] not in r["text"] for s in spans)
    assert after[10_003]["text"] == "one two <SECRET> three" or after[10_003]["text"] == 'one two <SECRET>" three'


def test_mixing_takes_whole_documents_near_the_targets(stages):
    before, after = {r["doc_id"]: r for r in stages[3][1]}, stages[4][1]
    assert stages[4][2] == stages[0][2]
    size = {i: len(WORD.findall(r["text"])) for i, r in before.items()}
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 3 and all(r["text"] == before[r["doc_id"]]["text"] for r in after)
    per, largest, taken = Counter(), Counter(), Counter()
    for i, r in before.items():
        per[r["source"]] += size[i]
        largest[r["source"]] = max(largest[r["source"]], size[i])
        taken[r["source"]] += copies[i] * size[i]
    names = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left = {}, set(names)
    while True:
        level = (sum(per.values()) - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 3 * per[s]}
        if not over:
            break
        want |= {s: 3 * per[s] for s in over}
        left -= over
    want |= {s: weight[s] * level for s in left}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in names)


def test_packing_holds_every_copy(stages):
    copies = Counter(r["doc_id"] for r in stages[4][1])
    assert Counter(r["doc_id"] for r in stages[5][1] if r["piece"] == 0) == copies
    bins = defaultdict(list)
    for r in stages[5][1]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, none, SF)
        assert found.collect() == [] and (name == "best_fit_packing" or found.columns == none.columns)


def test_stages_take_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(30)
    odd = odd.unionAll(odd.limit(5)).unionAll(odd.limit(5).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")).unionAll(odd.limit(2).selectExpr("doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars"))
    clashing = odd.selectExpr("*", "1 as row", "2 as id", "3 as size", "4 as target", "5 as before", "6 as item", "7 as root", "8 as position", "9 as taken", "10 as _row")
    clashing = stored(clashing, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, clashing, SF), name)
        assert after.columns == clashing.columns
        if name == "language_id":
            assert after.count() == clashing.filter("text is not null").count()
        if name == "near_dedup":
            kept = [r["text"].lower() for r in after.collect()]
            assert len(kept) == len(set(kept))
        clashing = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, clashing, SF).collect()
    assert sum(r["piece"] == 0 for r in pieces) == clashing.count()
