"""Documents drawn to resemble a target: importance resampling over hashed features.

Words come from an untrained pre-tokeniser, a Regex Split over lower-cased
text, with their offsets.  A feature is a run of words, cut from the words'
text by the offsets of its first and its last word; its CRC is its bucket.
Features are hashed once and kept as bucket numbers, two bytes each; the
histogram and the gains are sums over those.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 10_000
#: Most words of a feature.
LONGEST = 1
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
#: Documents drawn of a hundred.
PERCENT = 10
SEED = "2024"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters handed to the pre-tokeniser at once, so that its tuples stay few; the cut is between words.
_PIECE = 1 << 18
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _PIECE:
        cut = _BETWEEN.search(text, at + _PIECE)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def splitter():
    """The pre-tokeniser: what the pattern matches are words, the rest goes."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(_TERM), behavior="removed", invert=True)


def words_of(split, lowered: str) -> list[str]:
    return [word for piece in _pieces(lowered) for word, _ in split.pre_tokenize_str(piece)]


def _features(words: list[str], longest: int) -> list[str]:
    """Runs of 1 to ``longest`` words joined by one blank: slices between offsets of the joined words."""
    if longest == 1 or not words:
        return words
    joined = " ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    return [joined[a:b] for k in range(min(longest, len(words))) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist())]


def _bucketed(longest: int, buckets: int):
    """Per row: its number of words, and the bucket of each feature as unsigned integers of ``_kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kind = splitter(), _kind(buckets)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, found = [], []
                # words of several rows are numbered together, so that each different one is hashed once
                for text in pc.ascii_lower(pc.fill_null(part.column("text"), "")).to_pylist():
                    words = words_of(split, text)
                    n.append(len(words))
                    found.append(_features(words, longest))
                flat = pa.array([f for row in found for f in row], pa.large_string()).dictionary_encode()
                bucket = np.array([zlib.crc32(f.encode()) % buckets for f in flat.dictionary.to_pylist()], kind)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, kind)
                ends = np.cumsum([len(row) for row in found])
                held = [bucket[b - len(row) : b].tobytes() for b, row in zip(ends.tolist(), found)]
                rest = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(held, pa.binary())], names=[*(c for c in part.schema.names if c != "text"), "n_words", "buckets"])

    return run


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _histogram(buckets: int):
    """One row for each task: how many features lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column("buckets"):
                total += np.bincount(np.frombuffer(held.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def _counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: ``buckets`` numbers, however many documents."""
    out = np.zeros(buckets, np.int64)
    for row in hashed.select("buckets").mapInArrow(_histogram(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much more likely, smoothed by one, a bucket is in the target than in the corpus)."""
    big_s, big_t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * big_s / ((s + 1.0) * big_t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(gains: np.ndarray, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for held in batch.column("buckets"):
                own = np.frombuffer(held.as_buffer(), kind)
                n.append(len(own))
                weight.append(int(gains[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def _noise(seed: str) -> Column:
    """floor(1000 * a Gumbel number) that the document's id decides."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` stored, with ``place`` from 1 in ``order``: ranges are sorted apart, and each begins where those before it end.

    ``order`` should tell all rows apart, so that no range grows by ties.
    """
    number = F.monotonically_increasing_id()
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", number), name)
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row for each range
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    return sorted_.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("start") + local + 1).drop("part", "start", "_at")


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    Words are runs of ASCII letters (case aside), digits and characters beyond
    ASCII; null and empty texts have none.  ``weight`` is the mean gain of the
    features, rounded down (0 without any); ``score`` adds noise that the id
    decides.  Of the N rows with at least ``least_words`` words, N * percent //
    100 have a rank: those of the highest score, ties by smaller doc_id (null
    last).  Rows that repeat or share a doc_id are rows of their own.  An empty
    ``target`` (text) leaves gains that only smooth the corpus; no documents, no
    rows.  Other columns play no part.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    hashed = stored(own.mapInArrow(_bucketed(longest, buckets), f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, buckets binary"), "buckets")
    aimed = target.select("text").mapInArrow(_bucketed(longest, buckets), "n_words long, buckets binary")
    gains = bucket_gains(_counts(hashed, buckets), _counts(aimed, buckets))
    weighed = hashed.mapInArrow(_weighed(gains, _kind(buckets)), f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + _noise(seed)).withColumn("short", F.col("n_words") < least_words)
    placed = ranked(scored, [F.asc("short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "ranked")
    drawn = placed.filter("not short").count() * percent // 100
    rank = F.when(~F.col("short") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
