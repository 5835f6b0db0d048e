"""Decontamination, whitening and resampling against brute force, with the edge cases each documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import decontamination, resampling, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, row string, window string, n_hit string, weight string"
ITEM = "item_id long, text string, row string, words string, place string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOC)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], ITEM)


def hits(docs, benchmark, size):
    out = []
    for doc_id, text in docs:
        w, hit, found = terms(text), set(), set()
        for item_id, item in benchmark:
            own = terms(item)
            for k in range(max(1, len(own) - size + 1)) if own else ():
                window = own[k : k + size]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found |= {str(item_id)} - {"None"}
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaky(seed=5):
    """Documents and items of few words, so that shingles are shared, with passages whole, cut, recased and respaced."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Größe", "ñandú", "42"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    benchmark = [(k, text(rnd.choice((4, 10, 11, 25)))) for k in range(30)] + [(7, "seven words of an item seen twice"), (7, "w1 w2"), (100, "Solo"), (101, ""), (102, None), (103, " .,! "), (None, "an item that has no id at all but words enough"), (104, "y" * 3000 + " w1 w2 w3 w4")]
    docs = [(k, text(200)) for k in range(12)]
    for k in range(60):
        item = benchmark[rnd.randrange(len(benchmark))][1] or ""
        part = terms(item)[rnd.randrange(3) :][: rnd.randrange(4, 30)]
        docs.append((100 + k, text(20) + " -- " + rnd.choice([" ", "\n\t", "; "]).join(part).upper().replace("SS", "ss") + ". " + text(20)))
    long = " ".join([text(3000), benchmark[3][1], text(3000)])
    return docs + [(200, None), (201, ""), (202, "?!"), (203, "solo"), (203, "solo"), (203, "SOLO and w1 w2"), (None, "w1 w2"), (204, long), (205, "x" * 300_000 + " solo " + "x" * 300_000), (206, "y" * 3000 + " w1 w2 w3 w4"), (207, "Solo" * 2)], benchmark


@pytest.mark.parametrize("size, width", [(10, 3), (4, 2), (1, 1)])
def test_contaminations_match_brute_force(spark, size, width):
    docs, benchmark = leaky()
    found = decontamination.contaminations(documents(spark, docs), items(spark, benchmark), size, width)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"]
    want = hits(docs, benchmark, size)
    assert sorted((tuple(r[:6]) for r in found.collect()), key=repr) == want
    assert 20 < sum(r[5] for r in want) < len(want)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """With 16 bits for all shingles nearly every shingle passes, and joins decide."""
    monkeypatch.setattr(decontamination, "LEAST_BITS", 15)
    monkeypatch.setattr(decontamination, "BITS_EACH", 1)
    docs, benchmark = leaky(6)
    found = decontamination.contaminations(documents(spark, docs), items(spark, benchmark))
    assert sorted((tuple(r[:6]) for r in found.collect()), key=repr) == hits(docs, benchmark, 10)


def test_contaminations_of_empty_tables(spark):
    docs, benchmark = leaky()
    assert decontamination.contaminations(documents(spark, []), items(spark, benchmark)).count() == 0
    found = decontamination.contaminations(documents(spark, docs[:5]), items(spark, [])).collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in found] == [(0, 0, False)] * 5


def resample(docs, aims, longest, least, percent):
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    corpus = Counter(bucket(f) for _, t in docs for f in runs(terms(t)))
    target = Counter(bucket(f) for t in aims for f in runs(terms(t)))
    big_s, big_t = sum(corpus.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (big_s + 10000) / ((corpus[b] + 1) * (big_t + 10000))))
    rows = []
    for k, (i, t) in enumerate(docs):
        own = runs(terms(t))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain(bucket(f)) for f in own) / len(own)) if own else 0
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(t)) >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 50)])
def test_resampling_matches_brute_force(spark, longest, percent):
    docs, benchmark = leaky()
    docs = [*docs, (3, docs[3][1]), (3, docs[3][1])]
    aims = [t for _, t in benchmark]
    found = resampling.resampled(documents(spark, docs), items(spark, benchmark), longest, percent=percent)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=repr)
    assert got == resample(docs, aims, longest, 20, percent)


def test_resampling_of_empty_tables(spark):
    docs, benchmark = leaky()
    assert resampling.resampled(documents(spark, []), items(spark, benchmark)).count() == 0
    found = resampling.resampled(documents(spark, docs), items(spark, []), percent=100)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=repr)
    assert got == resample(docs, [], 1, 20, 100)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resampling, "_PIECE", 7)
    text = "eins zwei-drei vierundzwanzigtausend, fünf  sechs" * 40
    assert resampling.words_of(resampling.splitter(), text) == TERM.findall(text)


def test_target_like_documents_are_drawn_first(spark):
    rnd = random.Random(1)
    near, far = [f"near{k}" for k in range(300)], [f"far{k}" for k in range(300)]
    docs = [(k, " ".join(rnd.choice(near if k % 10 == 0 else far) for _ in range(80))) for k in range(500)]
    aims = [(k, " ".join(rnd.choice(near) for _ in range(80))) for k in range(50)]
    drawn = resampling.resampled(documents(spark, docs), items(spark, aims)).filter("rank is not null").select("doc_id").collect()
    assert len(drawn) == 50 and sum(r["doc_id"] % 10 == 0 for r in drawn) >= 40


VECTORS = "vec_id long, embedding array<double>, n string, component string"


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], VECTORS)


def spread(count=300, dim=7, seed=2):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(count, dim)) * np.linspace(3, 0.2, dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]


def whiten(rows, components=4):
    """By vec_id and component: n, deviation, the absolute whitened value, explained."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in whole}), float)
    n, mean, sums = len(fit), fit.mean(axis=0), [sum(c) for c in zip(*{tuple(x) for _, x in whole})]
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return sorted((i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), abs(float((x - mean) @ vectors[:, k]) / math.sqrt(values[k])), values[k] / values.sum()) for i, x in whole for k in range(min(components, len(values))))


@pytest.mark.parametrize("blocks", [(1024, 1024), (16, 3)])
def test_whitening_matches_numpy(spark, blocks):
    rows = list(enumerate(spread().tolist()))
    rows += [(900 + k, rows[5][1]) for k in range(150)] + [(5, rows[6][1]), (1000, [-0.0] * 7)]
    bad = [(2000, None), (2001, []), (2002, [None] + [1.0] * 6), (2003, [float("nan")] * 7), (2004, [float("inf")] + [0.0] * 6), (2005, [1e30] + [0.0] * 6)]
    found = whitening.whitened(embedded(spark, rows + bad), block_rows=blocks[0], block_columns=blocks[1])
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in found.collect())
    want = whiten(rows)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-8, atol=1e-8)
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9
    # one sign for all rows
    signed = {(r["vec_id"], r["component"]): r["whitened"] for r in found.filter("vec_id < 300 and vec_id <> 5").collect()}
    assert abs(np.corrcoef([signed[i, 1] for i in range(300) if i != 5], [dict(rows)[i] for i in range(300) if i != 5] @ np.linalg.eigh(np.cov(spread().T))[1][:, -1])[0, 1]) > 0.999


def test_whitening_of_several_lengths_flat_and_empty_tables(spark):
    a, b = spread(40, 3, 4).tolist(), spread(60, 2, 5).tolist()
    found = whitening.whitened(embedded(spark, [*enumerate(a), *((100 + k, v) for k, v in enumerate(b)), (None, [0.5, 1.5])]))
    got = Counter((r["n"], r["component"], r["vec_id"] is None) for r in found.collect())
    assert got == {(40, 1, False): 40, (40, 2, False): 40, (40, 3, False): 40, (61, 1, False): 60, (61, 2, False): 60, (61, 1, True): 1, (61, 2, True): 1}
    assert whitening.whitened(embedded(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(embedded(spark, [])).count() == 0
    line = whitening.whitened(embedded(spark, [(k, [float(k), 2.0 * k, 3.0]) for k in range(20)])).collect()
    assert {r["component"] for r in line} == {1} and max(r["identity_error"] for r in line) < 1e-9


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(1, [1e7, 0.0]), (2, [-1e7, 0.0]), (3, [3.0, 1e5]), (4, [0.0, -1e5])]
    found = {(r["vec_id"], r["component"]): r for r in whitening.whitened(embedded(spark, rows)).collect()}
    exact = whiten(rows)
    assert all(found[i, k]["deviation"] == (d if d < 2**63 else None) for i, k, _, d, _, _ in exact)
    assert {r[3] < 2**63 for r in exact} == {True, False}
