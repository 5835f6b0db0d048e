"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every distinct five-word shingle hash below one fixed fraction
of the hash range, the same for every document, so sketches of any two
documents can be merged (a union) and compared, however unequal their lengths.
Beside the hashes stand the number of distinct shingles and a digest of their
set: a text of few shingles may keep no hash at all, and still be told from an
empty one and known as a copy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import SHINGLE, mix, row_shingles

#: One of so many hashes is kept, of every document.
SCALE = 4
_BITS = 40
_BYTES = _BITS // 8


class Sketch(NamedTuple):
    """Sorted hashes below the threshold, the number of distinct shingles, and a digest of their set (both 0 where unknown)."""

    hashes: np.ndarray
    size: int = 0
    digest: int = 0


def sketch(hashes: np.ndarray, scale: int = SCALE) -> Sketch:
    """The sketch of 64-bit shingle hashes; kept ones are cut to ``_BITS`` bits."""
    own = np.unique(hashes)
    short = np.unique(own >> np.uint64(64 - _BITS))
    kept = short[: np.searchsorted(short, np.uint64((1 << _BITS) // scale))]
    return Sketch(kept, len(own), int(mix(own).sum(dtype=np.uint64)) if len(own) else 0)


def written(s: Sketch) -> str:
    """size:digest:hashes, numbers in hexadecimal and the hashes as base64 of big-endian bytes."""
    data = s.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :]
    return f"{s.size:x}:{s.digest:x}:" + base64.b64encode(data.tobytes()).decode()


def read(fingerprint: str) -> Sketch:
    size, digest, coded = fingerprint.split(":")
    data = np.frombuffer(base64.b64decode(coded), np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, 8 - _BYTES :] = data
    return Sketch(wide.view(">u8").ravel().astype(np.uint64), int(size, 16), int(digest, 16))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard likeness: 1 for equal sets; else by the hashes kept, 0 if neither has any."""
    if (a.size, a.digest) == (b.size, b.digest) and (a.size or not len(a.hashes) + len(b.hashes)):
        return 1.0
    both = len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))
    either = len(a.hashes) + len(b.hashes) - both
    return both / either if either else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 0 if ``a`` shows none."""
    return len(np.intersect1d(a.hashes, b.hashes, assume_unique=True)) / len(a.hashes) if len(a.hashes) else 0.0


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents' shingles together; size and digest of a union are not known from its parts."""
    return Sketch(np.union1d(a.hashes, b.hashes))


def _sketches(texts: list[str], scale: int, size: int) -> list[Sketch]:
    return [sketch(h[at[i] : at[i + 1]], scale) for _, h, at in row_shingles(pa.array(texts, pa.string()), size) for i in range(len(at) - 1)]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compared(ids: list, texts: list[str], following: list[str], own: list, after: list, scale: int, size: int) -> list[pa.Array]:
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following)]
    changed = _sketches(edited, scale, size)
    columns = (
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [written(s) for s in own],
        [written(s) for s in changed],
        [likeness(a, b) for a, b in zip(own, changed)],
        [likeness(a, b) for a, b in zip(own, after)],
    )
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)]


def _in_order(scale: int, size: int):
    """Rows of a sorted partition, each compared with the next; the last has none here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                ids, texts = piece.column("doc_id").to_pylist(), pc.fill_null(piece.column("text"), "").to_pylist()
                own = _sketches(texts, scale, size)
                if held is not None:
                    ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
                held = ids[-1], texts[-1], own[-1]
                if len(ids) > 1:
                    yield pa.RecordBatch.from_arrays(_compared(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:], scale, size), names=[n for n, _ in _FIELDS])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a sorted partition: its number, first text, last id and last text."""
    first, last = None, None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1)
    if last is not None:
        row = [TaskContext.get().partitionId(), first.column("text")[0].as_py(), last.column("doc_id")[0].as_py(), last.column("text")[0].as_py()]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1] or ""]), pa.array([row[2]], pa.int64()), pa.array([row[3] or ""])], names=["part", "first_text", "doc_id", "text"])


def _across(scale: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text, following = (batch.column(n)[row].as_py() for n in ("doc_id", "text", "following"))
                own, after = _sketches([text, following], scale, size)
                yield pa.RecordBatch.from_arrays(_compared([doc_id], [text], [following], [own], [after], scale, size), names=[n for n, _ in _FIELDS])

    return run


def fingerprints(docs: DataFrame, scale: int = SCALE, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by as many
    of the next document, by ascending doc_id (null last, ties by text); after
    the last comes the first.  Null text is empty; an empty text's sketch is
    empty and like another only if that is empty too.  A text whose few hashes
    all lie above the threshold is like its copies (1) and nothing else (0).  A
    single row is its own next.  Rows that repeat, or share a doc_id, are rows
    of their own, next to each other.  Other columns play no part.
    """
    order = [F.asc_nulls_last("doc_id"), F.asc("text")]
    # a stated number of partitions is never coalesced, so both readers below see the same ones, from one shuffle
    # and there are at least as many as the input has splits, so that a range holds about a split's bytes at any size
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # ranges are by doc_id alone: the bounds are sampled on the driver, which must not see texts
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    inside = ranged.mapInArrow(_in_order(scale, size), _RESULT)
    # one row for each partition goes through the window, whatever the number of documents
    edges = ranged.mapInArrow(_edges, "part int, first_text string, doc_id long, text string")
    by_part = Window.orderBy("part")
    following = F.coalesce(F.lead("first_text").over(by_part), F.first("first_text").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = edges.select("doc_id", "text", following.alias("following"))
    return inside.unionAll(ends.mapInArrow(_across(scale, size), _RESULT))
