"""Cross-post clusters and independence of sources against a plain reading of the rules."""

import difflib
import random
import re
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from driftwood.functions.text import most_similarity, similarity
from driftwood.operators import likeness, origins

POST = "event string, source string, post_id long, title string, body string, published_at string, url string, poster string, origin string"


def made_posts(seed=3):
    rnd = random.Random(seed)
    words = ["dance", "night", "club", "live", "music", "doors", "ten", "entry", "free", "hall", "river", "friday", "석탄", "밤"]
    rows, number = [], 0
    for event in ("e1", "e2", "e3"):
        bases = [[rnd.choice(words) for _ in range(rnd.choice((6, 12, 60)))] for _ in range(3)]
        for source in range(14):
            for _ in range(rnd.choice((1, 1, 2))):
                text = list(rnd.choice(bases))
                for _ in range(rnd.choice((0, 0, 1, 2, 5))):
                    text[rnd.randrange(len(text))] = rnd.choice(words)
                number += 1
                title = rnd.choice([None, " ".join(text[:3]), " ".join(text[:3]).upper() + "!"])
                rows.append((event, f"s{source:02d}", number, title, " ".join(text[3:]), rnd.choice([None, "2024-01-0%d" % rnd.randrange(1, 9)]), rnd.choice([None, "https://a.example/%d/" % rnd.randrange(3), "https://b.example/x"]), rnd.choice([None, "http://i/1", "http://i/2", "http://i/3"]), rnd.choice([None] * 8 + ["s01"])))
    rows.append(("e4", "s01", 900, None, None, None, None, "http://i/1", None))
    rows.append(("e4", "s02", 901, "!", " ", None, None, "http://i/1", None))
    return rows


def norm(text):
    return " ".join(re.sub(r"[^0-9a-z가-힣]+", " ", text.lower()).split())


def latest(rows):
    events = {}
    for r in sorted(rows, key=lambda r: r[2]):
        events.setdefault(r[0], {})[r[1]] = r
    return {e: list(s.values()) for e, s in events.items()}


def clusters(rows):
    out = {}
    for event, posts in latest(rows).items():
        text = {p[1]: norm(" ".join(x for x in p[3:5] if x)) for p in posts}
        edges = []
        for i, a in enumerate(posts):
            for b in posts[i + 1 :]:
                x, y = text[a[1]], text[b[1]]
                sim = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
                poster = bool(a[7] and a[7] == b[7])
                host = bool(a[6] and b[6] and urlsplit(a[6]).netloc == urlsplit(b[6]).netloc)
                if sim >= 0.86 or (poster and sim >= 0.65):
                    edges.append((a[1], b[1], sim, poster, host))
        root = {p[1]: p[1] for p in posts}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, *_ in edges:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
        at = {p[1]: p[5] for p in posts}
        for s in root:
            mine = [e for e in edges if s in e[:2]]
            if mine:
                group = [x for x in root if find(x) == find(s)]
                origin = min(group, key=lambda x: (at[x] is None, at[x] or "", x))
                best = max(e[2] for e in mine)
                signals = [n for n, on in (("NEAR_DUPLICATE_TEXT", any(e[2] >= 0.86 for e in mine)), ("SAME_LINK_HOST", any(e[4] for e in mine)), ("SAME_POSTER_URL", any(e[3] for e in mine))) if on]
                out[event, s] = (find(s), round(best, 9), any(e[3] for e in mine), any(e[4] for e in mine), round((1.0 if s == origin else 0.5) + best / 10, 9), s == origin, len(group), ",".join(signals))
    return out


def found_clusters(spark, rows):
    found = origins.cross_posts(spark.createDataFrame(rows, POST), similarity)
    return found, {(r["event"], r["source"]): (r["cluster"], round(r["text_similarity"], 9), r["same_poster"], r["same_host"], round(r["origin_score"], 9), r["is_origin"], r["member_count"], r["signals"]) for r in found.collect()}


def test_clusters_match_a_plain_reading(spark):
    for seed in (3, 4):
        rows = made_posts(seed)
        want = clusters(rows)
        assert found_clusters(spark, rows)[1] == want
        assert {v[7] for v in want.values()} >= {"NEAR_DUPLICATE_TEXT", "SAME_POSTER_URL"} or len({v[7] for v in want.values()}) > 3


def test_copies_of_one_text_are_one_cluster_and_never_paired(spark):
    rows = [("e", f"s{k:04d}", k, "same words", "in every post", None, None, None, None) for k in range(400)] + [("e", "t", 1000, "same words", "in every port", "2024-01-01", None, None, None)]
    found = found_clusters(spark, rows)[1]
    assert len(found) == 401 and {v[0] for v in found.values()} == {"s0000"} and found["e", "t"][5]


def test_no_alike_pair_is_lost(spark):
    rnd = random.Random(9)
    for percent, size in ((86, 40), (65, 25), (45, 12)):
        texts = []
        for _ in range(12):
            base = [rnd.choice("abcdefgh ") for _ in range(rnd.randrange(1, size))]
            for edits in (0, 1, 3, 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rnd.randrange(len(copy))] = rnd.choice("abcdxyz")
                texts.append("".join(copy))
        texts = sorted(set(texts))
        df = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "g string, k long, text string")
        met = {(r["a"], r["b"]) for r in likeness.met_by_letters(df, ["g"], "k", percent).collect()}
        ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        alike = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if max(ratio(texts[i], texts[j]), ratio(texts[j], texts[i])) >= percent / 100}
        assert alike <= met and alike


STATED = [("s01", "s00", "INDEPENDENT", 1), ("s00", "s01", "RELATED", 0), ("s02", "s03", "RELATED", 1), ("s04", "s05", "UNKNOWN", 1), ("s06", "s07", "INDEPENDENT", 1), ("s06", "s08", "INDEPENDENT", 1), ("s07", "s08", "INDEPENDENT", 1)]


def test_verdicts_follow_the_order_of_evidence(spark):
    rows = made_posts()
    members, _ = found_clusters(spark, rows)
    names = sorted({(r["event"], r["cluster"]) for r in members.collect()})
    decided = [(*n, d, 1) for n, d in zip(names, ("CONFIRM_SYNDICATION", "CONFIRM_INDEPENDENT"))] + [(*names[1], "HOLD", 0)]
    with_status = origins.with_status(members, spark.createDataFrame(decided, "event string, cluster string, decision string, reviewed_at int"))
    status = {(r["event"], r["source"]): (r["cluster"], r["status"]) for r in with_status.collect()}
    posts = spark.createDataFrame(rows, POST)
    stated = spark.createDataFrame(STATED, "a string, b string, relationship string, at int")
    every = spark.createDataFrame([(e, a[1], b[1]) for e, ps in latest(rows).items() for a in ps for b in ps if a[1] <= b[1]], "event string, a string, b string")
    explicit = {}
    for a, b, kind, _ in sorted(STATED, key=lambda s: s[3]):
        explicit[frozenset((a, b))] = kind
    content = lambda p: norm(re.sub(r"https?://\S+", " ", " ".join(x for x in p[3:5] if x).lower())) or None
    url = lambda u: u and u.rstrip("/")
    want = {}
    for e, ps in latest(rows).items():
        for x in ps:
            for y in ps:
                if x[1] > y[1]:
                    continue
                same = lambda a, b: a is not None and a == b
                cx, cy = status.get((e, x[1])), status.get((e, y[1]))
                cluster = cx[1] if cx and cy and cx[0] == cy[0] else None
                poster = same(x[7], y[7])
                hard = same(x[8], y[8]) or x[8] == y[1] or y[8] == x[1] or same(content(x), content(y)) or same(url(x[6]), url(y[6]))
                by_cluster = {"CONFIRMED_SYNDICATION": "SYNDICATED", "AUTO_SUSPECTED_SYNDICATION": "RELATED", "CONFIRMED_INDEPENDENT": "INDEPENDENT"}.get(cluster)
                kind = "RELATED" if x[1] == y[1] else by_cluster or ("SYNDICATED" if hard else explicit.get(frozenset((x[1], y[1]))) or ("RELATED" if poster else "UNKNOWN"))
                want[e, x[1], y[1]] = kind
    got = {(r["event"], r["a"], r["b"]): r for r in origins.pair_verdicts(every, posts, stated, with_status).collect()}
    assert {k: r["relationship"] for k, r in got.items()} == want
    assert set(want.values()) == {"RELATED", "SYNDICATED", "INDEPENDENT", "UNKNOWN"}
    # the pairs that are asked for by themselves hold every independent one
    few = {(r["event"], r["a"], r["b"]) for r in origins.stated_pairs(posts, stated, with_status).collect()}
    assert {k for k, v in want.items() if v == "INDEPENDENT"} <= few
    sets = {}
    for r in origins.independent_sources(origins.pair_verdicts(every, posts, stated, with_status)).collect():
        sets.setdefault(r["event"], set()).add(r["member"])
    assert sets and all(want[e, a, b] == "INDEPENDENT" for e, s in sets.items() for a in s for b in s if a < b)


def test_letter_runs_are_merged_and_never_broadcast(spark):
    # files of runs are far smaller than their rows: a broadcast by their size fills the driver
    df = spark.createDataFrame([("g", k, f"one text of many words {k}") for k in range(20)], "g string, k long, text string")
    met = likeness.met_by_letters(df, ["g"], "k", 86)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_common_subsequence_bounds_likeness(spark):
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice("abc 밤") for _ in range(rnd.choice((0, 1, 9, 250))))
    rows = [(a := text(), rnd.choice((text(), a[: len(a) // 2] + "x" + a[len(a) // 2 :], a))) for _ in range(120)]
    for r in spark.createDataFrame(rows, "a string, b string").withColumn("most", most_similarity("a", "b")).collect():
        both = [[0] * (len(r.b) + 1) for _ in range(len(r.a) + 1)]
        for i, x in enumerate(r.a):
            for j, y in enumerate(r.b):
                both[i + 1][j + 1] = both[i][j] + 1 if x == y else max(both[i][j + 1], both[i + 1][j])
        assert abs(r.most - (2 * both[-1][-1] / (len(r.a) + len(r.b)) if r.a or r.b else 1.0)) < 1e-9
        assert all(difflib.SequenceMatcher(None, *p).ratio() <= r.most + 1e-9 for p in ((r.a, r.b), (r.b, r.a)))
