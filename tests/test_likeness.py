"""Measuring alike texts: difflib's ratio of long texts without its cost, and small groups without their letters."""

import difflib
import random
import time

from driftwood.functions import text
from driftwood.operators import likeness


def made_pairs(count=300):
    rnd = random.Random(2)
    alphabets = ("abcdefgh 0123456789", "etaoinshrdlu zqxjk", "".join(chr(0xAC00 + i) for i in range(400)), "ab", "석탄밤 abc")
    for _ in range(count):
        letters = rnd.choice(alphabets)
        left = rnd.choices(letters, [rnd.random() ** 3 + 0.002 for _ in letters], k=rnd.choice((150, 230, 450, 900)))
        right = list(left)
        for _ in range(rnd.choice((0, 1, 3, 20, 100))):
            at = rnd.randrange(len(right))
            from_ = rnd.randrange(len(right))
            right[at : at + rnd.choice((0, 1))] = rnd.choice(([rnd.choice(letters)], [], right[from_ : from_ + rnd.randrange(30)])) or [letters[0]]
        yield "".join(left[: rnd.choice((len(left), rnd.randrange(len(left))))]), "".join(right)


def test_ratio_is_that_of_difflib():
    seen = []
    for a, b in made_pairs():
        for left, right in ((a, b), (b, a)):
            seen.append(difflib.SequenceMatcher(None, left, right).ratio())
            assert text.ratio(left, right) == seen[-1]
    assert any(s < 0.3 for s in seen) and any(0.3 < s < 0.9 for s in seen) and 1.0 in seen


def test_long_near_copies_are_measured_without_the_product_of_their_letters():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("etaoinshrdlucmfwypvbgkjqxz", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 1, 0.8, 0.3, 0.3, 0.3, 0.3], k=rnd.randrange(3, 9))) for _ in range(900)]
    left = [rnd.choice(words) for _ in range(2500)]
    right = [w if rnd.random() < 0.95 else rnd.choice(words) for w in left]
    left, right = " ".join(left), " ".join(right)
    began = time.process_time()
    want = difflib.SequenceMatcher(None, left, right).ratio()
    plain = time.process_time() - began
    began = time.process_time()
    got = text.similarity.func(*(text.pd.Series([t]) for t in (left, right)))[0]
    assert got == want and time.process_time() - began < plain / 4


def test_small_groups_meet_without_their_letters(spark, monkeypatch):
    def no_runs(*_):
        raise AssertionError("letters of a small group were looked at")

    rnd = random.Random(4)
    bases = ["".join(rnd.choices("abcdef ", k=rnd.randrange(9, 90))) for _ in range(10)]
    texts = sorted({base[:at] + rnd.choice("xyz") * rnd.randrange(3) + base[at:] for base in bases for at in range(1, 9)})
    df = spark.createDataFrame([(f"g{k % 2}", k, t) for k, t in enumerate(texts)] + [(None, 190, "aaa"), (None, 191, "aaab"), ("g2", 192, "")], "g string, k long, text string")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if a % 2 == b % 2 and difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.65}
    by_letters = met_of(spark, df, monkeypatch, 1)
    monkeypatch.setattr(likeness, "_runs", no_runs)
    direct = met_of(spark, df, monkeypatch, 64)
    assert want and want <= by_letters <= direct and all(a < b < 190 for a, b in direct)


def met_of(spark, df, monkeypatch, small):
    monkeypatch.setattr(likeness, "SMALL_GROUP", small)
    return {(r["a"], r["b"]) for r in likeness.met_by_letters(df, ["g"], "k", 65).collect()}
