"""The training operators against brute force, round trips and held-out accuracy, with the edge cases each documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import chat, fingerprints, langid, licenses, mixing, neardup, packing, pii, secret_scan, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, copies string, target string, part string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(spark, texts, sources=None):
    """Documents with further columns whose names clash with those of results."""
    rows = [(i, t, "xx", (sources or ["s"] * len(texts))[i], None, "a", "b", "c", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


EDGES = [None, "", " \t\n", "one", "ONE", "one two three four", "a b c d e", "A B C D E", "x" * 300_000, "wörd " * 4000, "wörd " * 4000]


def shingles(text):
    w = WORD.findall(lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [rnd.choice(words) for _ in range(120)]
    out = list(EDGES)
    for edits in (0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 8):
        copy = list(base)
        for _ in range(edits):
            copy[rnd.randrange(len(copy))] = f"new{rnd.random()}"
        out.append(" ".join(copy))
    shared = " ".join(rnd.choice(words) for _ in range(60))
    out += [shared + " " + " ".join(f"p{k}_{j}" for j in range(40)) for k in range(12)]
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = near_texts()
    found = neardup.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == groups(dict(enumerate(texts)))
    assert [f for f in found[0].asDict()] == ["doc_id", "n_shingles", "component_id", "kept"]


def test_near_duplicates_of_the_table(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert found == groups(texts)


def test_keep_one_keeps_columns_and_one_of_each(spark):
    d = documents(spark, ["a b c d e f", "A b c d e f", "other words entirely here now", None])
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_min_max_signature_agreement_estimates_likeness():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[500:]
    s = neardup.min_max_signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    assert abs(float((s[0] == s[1]).mean()) - 1 / 3) < 0.05


def test_empty_documents(spark):
    none = documents(spark, []).limit(0)
    for found in (neardup.near_duplicates(none), mixing.mixture(none), packing.packed_documents(none), secret_scan.find_secrets(none), licenses.find_licenses(none), langid.identified(none), pii.find_pii(none), fingerprints.fingerprints(none), mixing.training_order(none), neardup.keep_one(none)):
        assert found.collect() == []
    no_vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.top_k(no_vectors, F.col("vec_id") % 100 == 0).collect() == []
    assert chat.readback(chat.formatted(chat.events_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).collect() == []


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(5)
    vs = rnd.normal(size=(900, 16)).astype(np.float32)
    vs[300:340] = vs[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    rows += [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1100, []), (1200, [1.0, 2.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    ints = np.floor(1024 * vs.astype(np.float64)).astype(np.int64)
    found = defaultdict(list)
    for r in vectors.top_k(frame, F.col("vec_id") % 100 == 0, vector_block=128, query_block=4).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 900, 100):
        scores = ints @ ints[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert found.pop(q) == [(i, int(scores[i])) for i in best]
    assert not found


def test_top_k_of_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [2.0, 1.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 3.0])]
    found = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=4, vector_block=2, query_block=1).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"] >> 20))
    # 100 asks with the least of its vectors; rows that repeat are candidates each time
    assert by == {0: [(2, 3), (100, 2), (1, 1), (1, 1)], 100: [(2, 3), (1, 1), (1, 1), (0, 0)]}


def test_a_vector_on_a_third_of_all_rows(spark):
    rnd = np.random.default_rng(9)
    vs = np.floor(rnd.normal(size=(600, 8)) * 1024).astype(np.int64)
    vs[::3] = vs[0]
    ids = [7 if i % 5 == 0 else i for i in range(600)]
    ids[0] = 100
    frame = spark.createDataFrame([(i, [x / 1024 for x in v]) for i, v in zip(ids, vs.tolist())], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in vectors.top_k(frame, F.col("vec_id").isin(7, 100, 200, 201, 300), k=5, vector_block=64).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (7, 100, 201):
        asking = min((v for i, v in zip(ids, vs.tolist()) if i == q))
        want = sorted(((int(np.dot(asking, v)), i) for i, v in zip(ids, vs.tolist()) if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert found[q] == [(i, s) for s, i in want]


def test_vectors_too_long_for_64_bits_take_no_part(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e30, 1.0]), (2, [3.0, 1.0]), (100, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    found = vectors.top_k(frame, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 2, 1024 * 3072 + 2048 * 1024)]


def test_exact_vectors_are_read_for_survivors_only(spark):
    """Cells leave few of many vectors, and what they leave holds the best."""
    rnd = np.random.default_rng(8)
    vs = np.floor(rnd.normal(size=(3000, 16)) * 1024).astype(np.int64)
    low = vs.min(axis=0)
    width = (vs.max(axis=0) - low) // 256 + 1
    cells = ((vs - low) // width).astype(np.uint8)
    import pyarrow as pa

    side = pa.table({"row": np.arange(3000), "vec_id": np.arange(3000), "dim": np.full(3000, 16), "cells": pa.array([c.tobytes() for c in cells], pa.binary())})
    asked = pa.table({"query_id": np.arange(20), "sure": np.full(20, -np.inf), "q": pa.array([v.tobytes() for v in vs[:20]], pa.binary())})
    found = vectors._reaching(10, {16: low}, {16: width})((), side, asked)
    assert found.num_rows < 20 * 60
    by = defaultdict(set)
    for q, row in zip(found.column("query_id").to_pylist(), found.column("row").to_pylist()):
        by[q].add(row)
    for q in range(20):
        scores = vs @ vs[q]
        assert set(sorted((i for i in range(3000) if i != q), key=lambda i: (-scores[i], i))[:10]) <= by[q]


def test_mixing(spark, docs):
    rows = mixing.mixture(docs, bucket_rows=7).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    per, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(text[r["doc_id"]]["text"] or "")) and r["taken"] <= 3 * r["size"]
        per[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(rows) == len(text)
    names = sorted(per)
    total, open_ = sum(per.values()), set(names)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want = {}
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * per[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * per[s]
            open_.discard(s)
    want |= {s: weight[s] * level for s in open_}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    again = mixing.mixture(docs, bucket_rows=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_edges(spark):
    d = documents(spark, [None, "", "a b c", "d e", "f", "a b c"], ["x", "x", "y", None, "z", "y"])
    rows = {r["doc_id"]: r for r in mixing.mixture(d).collect()}
    assert rows[0]["size"] == rows[0]["taken"] == rows[0]["target"] == 0 and rows[0]["positions"] == []
    assert rows[3]["source"] is None and sum(r["taken"] for r in rows.values()) in (8, 9)
    ordered = mixing.training_order(d)
    assert ordered.columns == d.columns and max(Counter(r["doc_id"] for r in ordered.collect()).values()) <= 3


def test_training_order_takes_every_row_by_itself(spark):
    """Repeated rows, one id in two sources, rows without id: as many copies as the plan says, in order of position."""
    d = documents(spark, ["a b c d"] * 3 + ["e f g"] * 2 + ["h"] * 7, ["x", "x", "x", "y", "y"] + ["z"] * 7)
    d = d.withColumn("doc_id", F.when(F.col("doc_id") < 5, 1).when(F.col("doc_id") > 9, None).otherwise(F.col("doc_id"))).withColumn("before", F.lit("clash")).withColumn("row", F.lit(1))
    plan = mixing.mixture(d).collect()
    per, target = Counter(), {}
    for r in plan:
        per[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert len(r["positions"]) == r["copies"] and r["positions"] == sorted(r["positions"]) and all(0 <= p < 1 for p in r["positions"])
    assert {s: int(target[s] + 1e-6) for s in target} == dict(per)
    again = [sorted(map(str, mixing.training_order(d).collect())) for _ in range(2)]
    assert again[0] == again[1] and mixing.training_order(d).columns == d.columns
    words = Counter()
    for r in mixing.training_order(d).collect():
        words[r["source"]] += len(r["text"].split())
    longest = {"x": 4, "y": 3, "z": 1}
    assert all(abs(words[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in target)


def test_rows_come_in_order_of_position(spark, docs):
    rows = mixing.by_position(mixing.mixture(docs)).collect()
    first = [r["first_position"] for r in rows if r["first_position"] is not None]
    assert first == sorted(first) and [r["first_position"] for r in rows[len(first) :]] == [None] * (len(rows) - len(first))


def test_positions_invert_the_schedule(spark):
    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    for k, (a, m, b) in enumerate(mixing.SCHEDULES):
        area = lambda t: (t * a + (m - a) * t * t if t <= 0.5 else (a + m) / 4 + (t - 0.5) * m + (b - m) * (t - 0.5) ** 2) / ((a + 2 * m + b) / 4)  # noqa: B023, E731
        for r in shares.select("s", mixing.time_of_demand(F.col("s"), F.lit(k)).alias("t")).collect():
            assert abs(area(r["t"]) - r["s"]) < 1e-9


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = documents(spark, [None, "", "a <|endoftext|> b", "word " * 3000, "word " * 3000]).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    whole = docs.select("doc_id", "text").unionAll(extra).unionAll(extra)
    rows = packing.packed_documents(whole, with_ids=True, group_items=60, fan_in=3).collect()
    texts = Counter()
    for r in whole.collect():
        texts[r["doc_id"], r["text"] or ""] += 1
    bins = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 1024 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], tuple(r["ids"])))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for (doc_id, text), n in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want = Counter({(k, a, tuple(ids[a:b])): n for k, (a, b) in enumerate(zip(edges, edges[1:]))})
        assert Counter(by_doc[doc_id]) == want
    assert len(bins) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 2


def test_best_fit_takes_the_fullest_bin():
    assert sorted(map(sorted, packing.best_fit([6, 5, 4, 5], 10))) == [[0, 2], [1, 3]]


ASSIGN = re.compile(secret_scan.ASSIGN, re.ASCII | re.IGNORECASE)


def secrets_of(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join("%s:%d:%d" % s for s in sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))))


def test_secrets(spark, docs):
    rnd = random.Random(1)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [None, "", "ToKeN : 'abc' api-key=zz", "passwd==x password=\"päss\"", "token=token =abcdefg", "é AKIA" + "A" * 16 + " AKIAAKIA" + "0" * 20]
    texts += [f'ä token = "{h}"' for h in hexes[:40]] + [f"see {h[:22]} now" for h in hexes[40:50]] + ["Supercalifragilistic9expialidocious words/and/paths2 build-2024-01-01-release"]
    rows = {r["doc_id"]: r for r in secret_scan.find_secrets(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(secrets_of(t).encode()).hexdigest()
        assert set(filter(None, secrets_of(t).split(","))) <= set(rows[i]["spans"].split(","))
    # hexadecimal tokens too short for the base pattern follow the format learnt from the labelled ones
    assert sum("format" in rows[i]["spans"] for i in range(46, 56)) >= 8
    assert "format" not in rows[56]["spans"]
    for r in secret_scan.find_secrets(docs).collect():
        text = docs.filter(F.col("doc_id") == r["doc_id"]).first()["text"] if r["spans"] else ""
        assert not r["spans"] or hashlib.sha256(secrets_of(text).encode()).hexdigest() == r["base_sha256"]


def test_unlabelled_secrets_are_added_and_clean_texts_left_alone(spark, docs):
    """Credentials of the labelled format, planted without a label into real texts: recall and precision of the added spans."""
    rnd = random.Random(6)
    base = [r for r in docs.select("doc_id", "text").orderBy("doc_id").collect() if r["text"] and len(r["text"]) > 40]
    labelled = [(10_000 + i, 'ä token = "' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + '"') for i in range(60)]
    planted, rows = {}, []
    for k, r in enumerate(base):
        words = r["text"].split(" ")
        if k % 3 == 0:
            value = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randrange(18, 24)))
            words.insert(rnd.randrange(len(words)), value)
            planted[r["doc_id"]] = value
        rows.append((r["doc_id"], " ".join(words)))
    text = dict(rows)
    found = {}
    for r in secret_scan.find_secrets(spark.createDataFrame(rows + labelled, "doc_id long, text string")).collect():
        found[r["doc_id"]] = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("format")]
        assert r["n_format"] == len(found[r["doc_id"]])
    hits = sum(value in [text[i][a:b] for a, b in found[i]] for i, value in planted.items())
    wrong = sum(text[i][a:b] != planted.get(i) for i in text for a, b in found[i])
    assert hits >= 0.95 * len(planted) and wrong <= 0.02 * len(text), (hits, wrong, len(planted))


def test_likelihoods_by_table_are_those_by_step():
    rnd = random.Random(2)
    automaton = secret_scan.infer([secret_scan.symbols("".join(rnd.choice("0123abcZ-") for _ in range(rnd.randrange(1, 9)))) for _ in range(300)])
    tokens = ["".join(rnd.choice("0123abcZ-q") for _ in range(n)) for n in [*(rnd.randrange(1, 12) for _ in range(200)), 400, 90]]
    text = "é ".join(tokens).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends = secret_scan.token_bounds(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == tokens
    for give_up in (False, True):
        steps, stop = secret_scan.log_likelihoods(automaton.tables(), data, starts, ends, give_up)
        for t, x in zip(tokens, steps + stop):
            costs = automaton.costs(secret_scan.symbols(t))
            seen, state = True, 0
            for c in secret_scan.symbols(t):
                seen = seen and c in automaton.steps[state]
                state = automaton.steps[state][c][0] if seen else 0
            assert x == pytest.approx(sum(costs)) if seen or not give_up else x == -np.inf


def test_redaction(spark):
    d = documents(spark, [None, "é token=abcdef123 end", "clean text"])
    rows = {r["doc_id"]: r for r in secret_scan.redacted(d).collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == "é <SECRET> end" and rows[1]["n_chars"] == 14 and rows[2]["text"] == "clean text"


def test_automaton_learns_a_format():
    values = ["0h" * n for n in range(4, 30)]
    a = secret_scan.infer(values)
    assert len(a.steps) < 8 and a.score("0h" * 12) > a.score("00" * 12)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = mit.replace("charge", "cost")
    texts = [None, "", "no terms here at all today", f"é é filler words {mit} more", f"intro {changed} outro", "x " * 5000 + "Released under the MIT License.", "LICENSED UNDER CC BY-NC 4.0", "License: apache like words version 2.0 license"]
    rows = {r["doc_id"]: r for r in licenses.find_licenses(documents(spark, texts)).collect()}
    assert [rows[i]["licenses"] for i in range(8)] == ["", "", "", "mit", "", "mit", "cc-by-nc-4.0", ""]
    name, a, b = rows[3]["spans"].split(":")
    assert texts[3][int(a) : int(b)] == mit
    near = licenses.find_licenses(documents(spark, [f"intro {changed} outro"]), share=0.6).first()
    assert near["licenses"] == "mit"


def test_licenses_against_an_exhaustive_scan(spark, docs):
    """Notices and whole licenses with words exchanged, dropped and added in real texts; every template is held against every place."""
    rnd = random.Random(21)
    templates = [(name, re.findall("[a-z0-9]+", t.lower())) for name, texts in licenses.TEMPLATES.items() for t in texts]
    base = [r["text"] or "" for r in docs.select("text").orderBy("doc_id").limit(120).collect()]
    texts = []
    for k, text in enumerate(base):
        words = text.split(" ")[:400]
        name, template = templates[k % len(templates)]
        copy = list(template)
        for _ in range(rnd.choice([0, 0, 1, 2]) if len(copy) < 40 else rnd.randrange(4)):
            at = rnd.randrange(len(copy))
            copy[at : at + 1] = rnd.choice([[], ["changed"], [copy[at], "more"]])
        words[len(words) // 2 : len(words) // 2] = copy
        texts.append(" ".join(words))

    def sets(words):
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    def contained(text):
        words = re.findall("[a-z0-9]+", re.sub("[^\x00-\x7f]", "ü", text.lower()).replace("ü", "z"))
        out = set()
        for name, template in templates:
            wanted = sets(template)
            hits = [i for i in range(max(1, len(words) - 4)) if tuple(words[i : i + 5]) in wanted]
            gap, run = max(12, 0.2 * len(wanted)), []
            for i in [*hits, 1 << 40]:
                if run and i - run[-1] > gap:
                    if len({tuple(words[j : j + 5]) for j in run}) >= 0.8 * len(wanted):
                        out.add(name)
                    run = []
                run.append(i)
        return out

    want = {(i, name) for i, t in enumerate(texts) for name in contained(t)}
    got = {(r["doc_id"], name) for r in licenses.find_licenses(documents(spark, texts)).collect() for name in filter(None, r["licenses"].split(","))}
    assert len(want) > 60 and len(got & want) >= 0.99 * len(want) and not got - want, (got - want, want - got)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|end|>\n <|turn|>x &lt; [INST]"), (1, 1, "assistant", None), (1, 2, "assistant", "answer\n\n&amp; ü𝄞"), (2, 5, None, "only"), (2, 5, None, "only"), (3, None, "as\nsistant", "z"), (3, 1, "assistant", "a" * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.events_of(frame))
    found = {r["conv_id"]: r for r in chat.readback(made).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else 1 << 62, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert found[c]["n_turns"] == len(turns)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in made.collect():
        assert len(r["formatted"]) == found[r["conv_id"]]["formatted_chars"]


def test_chat_events_fold(spark):
    log = [
        (1, 0, 1, "message", "user", "q"), (1, 1, 3, "delta", None, "lo"), (1, 1, 2, "delta", "assistant", "hel"), (1, 2, 4, "message", "user", "next"), (1, 3, 5, "delta", "assistant", "gone"),
        (1, 1, 6, "regenerate", None, "new"), (1, 1, 7, "delta", None, "er"), (1, 2, 8, "message", "user", "again"), (1, 2, 9, "edit", None, "edited"), (1, 0, 10, "odd", None, "?"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = [(r["message"], r["role"], r["text"]) for r in chat.messages(events).orderBy("message").collect()]
    assert got == [(0, "user", "q"), (1, "assistant", "newer"), (2, "user", "edited")]


def test_a_log_folds_to_the_rows_it_was_kept_of(spark):
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "abc" * 700), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 3, None, "x"), (2, None, "assistant", "ü𝄞" * 500), (2, 4, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    log = chat.logged(frame, delta_chars=7)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = chat.messages(log.orderBy(F.xxhash64("seq"))).collect()
    want = Counter((c, t if t is not None else (1 << 63) - 1, r or "", x or "") for c, t, r, x in rows)
    assert Counter((r["conv_id"], r["message"]["turn"], r["role"], r["text"]) for r in got) == want


def test_language_accuracy_and_edges(spark, docs):
    rows = langid.identified(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    model = langid.learn(docs)
    edge = langid.identify(documents(spark, [None, "", "123 ... !", "Привет мир", "the and that with of to", "the and " * 20000]), model)
    found = {r["doc_id"]: r for r in edge.collect()}
    assert [found[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and found[0]["score"] == 0
    assert found[3]["lang_pred"] in model.languages and found[4]["lang_pred"] == found[5]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_best_path_is_viterbi():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 6):
        for _ in range(60):
            scores = rng.normal(size=(n, 3)) * 4
            best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:])))
            value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert abs(value(langid.best_path(scores, 3.0)) - value(best)) < 1e-9


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii_of(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_matches_the_patterns(spark, docs):
    texts = [None, "", "a@b.c@d.ef x@y.zz+w@v.uu", "𝄞é a.b+c@mail.example.com, 1.2.3.4.5 and 256.1.1.1 or 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +12 3 4", "+" + "1" * 14 + " " + "7" * 5000, "1 2 " * 20000, "a@" * 3000, "x@y.zz " * 300]
    rnd = random.Random(4)
    texts += ["".join(rnd.choice("0123456789 .-+@ab()é") for _ in range(120)) for _ in range(150)]
    d = documents(spark, texts)
    rows = {r["doc_id"]: r for r in pii.find_pii(d).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(pii_of(t).encode()).hexdigest(), (i, t[:80])
        assert set(filter(None, pii_of(t).split(","))) <= set(rows[i]["spans"].split(","))


def test_weak_labelers_are_weighed():
    patterns = {("id", "11"): 0}
    counts = {("card", "1111", "2s"): 60.0, ("card", "0-01", "2s"): 5.0, ("card", "000-", "3p"): 300.0, ("card", "01-1", "2s"): 3.0}
    chances = pii.classifier(counts)
    assert chances["card", "1111", "2s"] > 0.95 > 0.5 > chances["card", "000-", "3p"] and patterns
    prior, rate = pii.reliabilities({(k, v): n for (k, v, _), n in counts.items()})
    assert rate["card", 0][0] > rate["card", 0][1]


def test_method_adds_what_base_patterns_miss(spark, docs):
    """Names, addresses, account numbers and national ids planted into real texts: recall, and precision on the texts as they were."""
    rnd = random.Random(12)
    people = ["Maria Schmidt", "John Miller", "José García", "Camille Durand", "Peter Q. Wagner", "Ana López"]
    streets = ["221 Baker Street, London", "Hauptstraße 15, 10115 Berlin", "12 rue de Rivoli, 75001 Paris", "Calle Mayor 7, 28013 Madrid"]
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "ES9121000418450200051332"]
    ids = ["123-45-6789", "219-09-9999"]
    base = [r for r in docs.select("doc_id", "text").orderBy("doc_id").collect() if r["text"]]
    planted, rows = {}, []
    for k, r in enumerate(base):
        value = rnd.choice([people, streets, accounts, ids][k % 4])
        words = r["text"].split(" ")
        words.insert(len(words) // 2, value)
        rows.append((r["doc_id"], " ".join(words)))
        planted[r["doc_id"]] = value
    text = dict(rows)
    caught = Counter()
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        found = [text[r["doc_id"]][int(a) : int(b)] for _, a, b in spans]
        assert r["n_spans"] == len(spans) == r["n_added"] + r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
        caught[any(f in planted[r["doc_id"]] and len(f) >= len(planted[r["doc_id"]].split(",")[0]) for f in found)] += 1
    clean = {r["doc_id"]: r["n_added"] for r in pii.find_pii(docs).collect()}
    assert caught[True] >= 0.9 * len(planted), caught
    assert sum(n > 0 for n in clean.values()) <= 0.01 * len(clean), sum(clean.values())


def test_pii_runs_without_python(spark, docs):
    plan = pii.proposed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints(spark, docs):
    d = docs.repartition(5)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(d).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    errors = []
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t = texts[i]
        edited = t[: len(t) - len(t) // 4] + texts[nxt][: len(t) // 4]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
        assert r["near_next"] == fingerprints.likeness(fingerprints.read(r["fingerprint"]), fingerprints.read(rows[nxt]["fingerprint"]))
    assert np.mean(errors) < 0.05
    same = defaultdict(set)
    for i in ids:
        same[texts[i]].add(rows[i]["fingerprint"])
    assert all(len(s) == 1 for s in same.values())


def test_fingerprint_edges_and_merging(spark):
    rows = sorted(fingerprints.fingerprints(documents(spark, [None, "", "one", "ab" * 10, "x " * 50_000])).collect(), key=lambda r: r["doc_id"])
    assert rows[0]["n_chars"] == 0 and rows[0]["near_next"] == 1.0 and rows[1]["near_next"] == 0.0
    assert fingerprints.fingerprints(documents(spark, ["a b c d e f g h"])).first()["near_next"] == 1.0
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    small, large = fingerprints.sketch(h[:1000]), fingerprints.sketch(h)
    assert abs(fingerprints.containment(small, large) - 1) < 0.05 and abs(fingerprints.containment(large, small) - 0.25) < 0.07
    assert np.array_equal(fingerprints.merged(small, fingerprints.sketch(h[1000:])).hashes, large.hashes)


def test_every_document_keeps_the_same_fraction(spark, docs):
    limit = (1 << 40) // fingerprints.SCALE
    for r in fingerprints.fingerprints(docs).collect():
        kept = fingerprints.read(r["fingerprint"])
        assert fingerprints.written(kept) == r["fingerprint"]
        assert not len(kept.hashes) or kept.hashes.max() < limit
        assert abs(len(kept.hashes) - kept.size / fingerprints.SCALE) <= 5 * (kept.size / fingerprints.SCALE) ** 0.5 + 3


def test_fingerprints_of_repeated_rows_and_short_copies(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "other words"), (None, "a b c d e"), (None, None)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5 and len({r["fingerprint"] for r in found if r["n_chars"] == 9}) == 1
    # copies are known even where no hash of theirs is kept (the last row is followed by the first), and strangers are not alike
    assert sorted(r["near_next"] for r in found) == [0.0, 0.0, 0.0, 1.0, 1.0]
