"""Language identification of mixed text.

Letters form words.  A word's script decides which languages may own it; each
of those gets the word's score, the sum of log probabilities of its letter
trigrams; Viterbi over the words, with a penalty for every switch, labels spans
of one language.  The document's language owns the most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
#: Trigrams are hashed into so many bins.
BINS = 1 << 15
#: The model is fitted on about so many labelled rows of each language.
SAMPLE_ROWS = 2000
#: What a switch of language costs, in units of log probability.
SWITCH = 12.0
#: A language owns a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.005
#: Predicted where there is nothing to tell.
UNKNOWN = "und"
_CHUNK = 200_000
_TOP = 0x32400


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case of letters (0 for others), script number, and whether it is a letter."""
    lower, script = np.zeros(_TOP, np.uint32), np.zeros(_TOP, np.uint8)
    for c in range(_TOP):
        if unicodedata.category(chr(c))[0] == "L":
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = number
    return lower, script, lower > 0


_cached: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered code points (0 outside letters) of all texts with a gap after each, their scripts, and the texts' starts."""
    if not _cached:
        _cached.append(_tables())
    lower, script, _ = _cached[0]
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    points = np.where(points < _TOP, points, 0)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return lower[points], script[points], np.concatenate([[0], np.cumsum(lengths)])


def _trigrams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and position of every trigram of a word and its edges; first and last + 1 positions of words."""
    solid = letters > 0
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(before & ~solid)
    at = np.flatnonzero(solid | before)
    c = letters.astype(np.uint64)
    b = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    a = np.where(b > 0, np.concatenate([[0, 0], c[:-2]]).astype(np.uint64), 0).astype(np.uint64)
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bins = (mixed >> np.uint64(40)) % np.uint64(BINS)
    return bins[at].astype(np.int64), at, starts, ends


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > _CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Model:
    """Log probabilities of trigram bins [BINS, language], and which language may own which script [script, language]."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lo, hi in _groups(texts):
            letters, scripts, starts = _letters(texts[lo:hi])
            bins, at, _, _ = _trigrams(letters)
            row = np.searchsorted(starts, at, side="right") - 1
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                grams, used = seen.setdefault(langs[lo + i], (np.zeros(BINS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
                grams += np.bincount(bins[cut[i] : cut[i + 1]], minlength=BINS)
                own = slice(starts[i], starts[i + 1])
                used += np.bincount(scripts[own][letters[own] > 0], minlength=len(used))
    for lang, (grams, used) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([grams.tolist()], pa.list_(pa.int64())), pa.array([used.tolist()], pa.list_(pa.int64()))], names=["lang", "grams", "used"])


def held_out():
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0 (a null id never is)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text, lang): about ``sample_rows`` rows of each language, by a hash of the id.

    Held-out rows and rows with null lang or text are left out.  One array of
    counts for each language comes to the driver, whatever the input's size.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.lit(0.0)
    for lang, n in sorted(totals.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    picked = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1_000_000)) < share * 1_000_000)
    counted = picked.select("lang", "text").mapInArrow(_counts, "lang string, grams array<long>, used array<long>")
    add = lambda c: F.expr(f"aggregate(collect_list({c}), array_repeat(0L, size(first({c}))), (s, x) -> zip_with(s, x, (a, b) -> a + b))")
    rows = sorted(counted.groupBy("lang").agg(add("grams").alias("grams"), add("used").alias("used")).collect(), key=lambda r: r["lang"])
    grams = np.array([r["grams"] for r in rows], np.float64).T
    used = np.array([r["used"] for r in rows], np.float64).T
    smooth = grams + 0.05
    scores = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    allowed = used >= SCRIPT_SHARE * np.maximum(used.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model([r["lang"] for r in rows], scores, allowed)


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word, maximising the scores less ``switch`` for each change."""
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    # where no stretch of words favours another language by half a switch, one language is best throughout
    if (gain - np.vstack([np.zeros((1, k)), low[:-1]])).max() <= switch / 2:
        return np.full(n, best)
    back = np.empty((n, k), np.int32)
    rows = scores.tolist()
    value, every = rows[0], range(k)
    for t in range(1, n):
        top = max(every, key=value.__getitem__)
        floor, row, came, now = value[top] - switch, rows[t], back[t], [0.0] * k
        for j in every:
            if value[j] >= floor:
                came[j], now[j] = j, value[j] + row[j]
            else:
                came[j], now[j] = top, floor + row[j]
        value = now
    path = np.empty(n, np.int64)
    path[-1] = max(every, key=value.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(texts: list[str], model: Model, switch: float = SWITCH) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: its language, the share of its letters in that language, and spans (start, end, language)."""
    for lo, hi in _groups(texts):
        letters, scripts, text_starts = _letters(texts[lo:hi])
        bins, at, starts, ends = _trigrams(letters)
        if not len(starts) or not model.languages:
            yield from ((UNKNOWN, 0.0, []) for _ in range(hi - lo))
            continue
        scores = np.add.reduceat(model.scores[bins], np.searchsorted(at, starts), axis=0)
        scores = np.where(model.allowed[scripts[starts]], scores, scores.min() - 1000.0)
        cut = np.searchsorted(starts, text_starts)
        for i in range(hi - lo):
            a, b = cut[i], cut[i + 1]
            if a == b:
                yield UNKNOWN, 0.0, []
                continue
            path = best_path(scores[a:b], switch)
            weight = np.bincount(path, weights=ends[a:b] - starts[a:b], minlength=len(model.languages))
            top = int(weight.argmax())
            edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [b - a]])
            spans = [(int(starts[a + x] - text_starts[i]), int(ends[a + y - 1] - text_starts[i]), model.languages[path[x]]) for x, y in zip(edges, edges[1:])]
            yield model.languages[top], float(weight[top] / weight.sum()), spans


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score and lang_spans: doc_id, lang_pred, score, lang_spans.

    Null text and text without letters get ``und`` and score 0; any other text
    gets a learned language (``und`` if none was learned).  Spans are in code
    points, end exclusive.  Only the text decides; repeated rows repeat.
    Languages that tie go by their name.  No rows in: no rows out.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = list(label(pc.fill_null(part.column("text"), "").to_pylist(), model, switch))
                spans = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "lang_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, lang_spans array<struct<start:long,end:long,lang:string>>")


def identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, switch: float = SWITCH) -> DataFrame:
    """Learns from ``docs`` (doc_id, text, lang) and labels every row: doc_id, held_out, lang_pred, score, lang_spans."""
    return identify(docs, learn(docs, sample_rows), switch).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_spans")


def keep_identified(docs: DataFrame, least_score: float = 0.3, **settings) -> DataFrame:
    """``docs`` without those in no known language or a hopeless mixture; all columns stay.

    A row is judged by its text alone: rows that repeat stay or go together,
    null ids play no part.  Null texts and texts without letters go.  Languages
    that tie go by their name.  No rows in: no rows out.
    """
    model = learn(docs, settings.get("sample_rows", SAMPLE_ROWS))
    switch, schema = settings.get("switch", SWITCH), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = label(pc.fill_null(part.column("text"), "").to_pylist(), model, switch)
                yield part.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
