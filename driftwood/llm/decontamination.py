"""Benchmark passages in documents, by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words (one, if it is
shorter), a window into shingles.  A window that occurs whole needs each of its
shingles, so the rarest one in the documents is prefix enough: documents and
windows meet on it alone.  A meeting pair is kept if the document has the
words before and after the shingle that the window's length and the shingle's
place in it ask for, and if those words are the window's, one by one.

Documents are read twice.  Both readings look shingles up in a bitmap of at
most MOST_BITS bits, which is all that is sent to tasks; a bitmap too small for
a large benchmark lets more shingles through to the joins and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored
from .shingles import BETWEEN_TERMS, runs, text_chunks, word_hashes, words

#: Consecutive words of an item that make a window, and of a window that make a shingle.
WINDOW = 10
WIDTH = 3
#: Bits of a bitmap for each of its shingles, and in all (16 MB).
BITS_EACH = 1024
LEAST_BITS, MOST_BITS = 20, 27
#: Bytes that part words become blanks, capital letters of ASCII small ones.
_FOLD = bytes(0x20 if BETWEEN_TERMS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _folded(data: bytes) -> bytes:
    return b" ".join(data.translate(_FOLD).split())


def _cut(window: int):
    """item_id and each window of the item's words, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = _folded((text or "").encode()).decode().split(" ")
                if own != [""]:
                    parts = [" ".join(own[k : k + window]) for k in range(max(1, len(own) - window + 1))]
                    of = batch.column("item_id").slice(i, 1).take(pa.array(np.zeros(len(parts), np.int64)))
                    yield pa.RecordBatch.from_arrays([of, pa.array(parts, pa.string())], names=["item_id", "words"])

    return run


def _shingled(width: int):
    """Of each window: its number of words, the bytes of its longest word, and its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, longest, tokens = [], [], []
            for _, _, data, offsets in text_chunks(batch.column("words")):
                starts, ends, rows = words(data, offsets, BETWEEN_TERMS)
                hashes = word_hashes(data, starts, ends)
                for a, b in zip(rows[:-1], rows[1:]):
                    n.append(b - a)
                    longest.append((ends[a:b] - starts[a:b]).max())
                    tokens.append(runs(hashes[a:b], np.array([0, b - a]), min(width, b - a))[0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("words"), pa.array(n, pa.int32()), pa.array(longest, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["words", "n", "longest", "tokens"])

    return run


class _Bitmap:
    """A set of shingles by the first bits of their hashes: never misses one, takes a few others for one."""

    def __init__(self, tokens: DataFrame):
        """``tokens`` has distinct ``token``."""
        spark = tokens.sparkSession
        self.power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * tokens.count()).bit_length()))
        slot = F.shiftrightunsigned("token", 64 - self.power) + 1
        rows = tokens.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
        bits = bytearray(1 << (self.power - 3))
        for row in rows:
            at = (row["bucket"] - 1) << 12
            bits[at : at + 4096] = row["bits"]
        self.bits = spark.sparkContext.broadcast(bytes(bits))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits.value, np.uint8)
        slot = hashes >> np.uint64(64 - self.power)
        return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(known: _Bitmap, widths: list[int]):
    """Shingles of the documents that may be a window's, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                starts, ends, rows = words(data, offsets, BETWEEN_TERMS)
                hashes = word_hashes(data, starts, ends)
                found = [h[known.has(h)] for h in (runs(hashes, rows, w)[0] for w in widths)]
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return run


_MET = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("context", pa.string())]))


def _met(known: _Bitmap, widths: list[int], window: int, longest: int):
    """row, doc_id, n_words, and the places of shingles that may be a window's prefix, each with the words around it.

    The words reach as far as a window can, and stop at one longer than any window's.
    """

    def around(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: np.ndarray, first: int, last: int, q: int) -> tuple[int, str]:
        a, b = max(first, q - window + 1), min(last, q + window)
        k = np.searchsorted(long, q)
        if k and long[k - 1] >= a:
            a = long[k - 1] + 1
        if k < len(long) and long[k] < b:
            b = max(long[k], q)
        return q - a, _folded(data[starts[a] : ends[b - 1]].tobytes()).decode() if b > q else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                starts, ends, rows = words(data, offsets, BETWEEN_TERMS)
                hashes = word_hashes(data, starts, ends)
                long = np.flatnonzero(ends - starts > longest)
                met: list[list] = [[] for _ in range(hi - lo)]
                for w in widths:
                    token, first = runs(hashes, rows, w)
                    hit = np.flatnonzero(known.has(token))
                    of = np.searchsorted(rows, first[hit], side="right") - 1
                    for h, r, q in zip(token[hit].view(np.int64).tolist(), of.tolist(), first[hit].tolist()):
                        before, context = around(data, starts, ends, long, int(rows[r]), int(rows[r + 1]), q)
                        if context:
                            met[r].append({"token": h, "at": q - int(rows[r]), "before": before, "context": context})
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), pa.array(met, _MET)], names=["row", "doc_id", "n_words", "met"])

    return run


def _prefixes(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """token, place, words, n, window: each window with its rarest shingle in the documents.  A window with one that no document has cannot occur."""
    dealt = windows.select("window", F.posexplode("tokens").alias("place", "token"))
    counts = docs.select("text").mapInArrow(_counted(_Bitmap(dealt.select("token").distinct()), widths), "token long, n long").groupBy("token").agg(F.sum("n").alias("held"))
    held = dealt.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token", "place")).alias("rarest"))
    return windows.join(held.filter("rarest.held > 0"), "window").select("rarest.token", "rarest.place", "words", "n", "window")


def contaminations(docs: DataFrame, items: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    Words are runs of ASCII letters (case aside), digits and characters beyond
    ASCII.  A window is ``window`` consecutive words of an item of ``items``
    (item_id, text), or all words of a shorter one; a document's word inside
    any occurrence of a window is hit.  ``item_ids`` are the items with
    occurring windows, sorted as strings; their digest is of the ids joined by
    commas (of an empty string, if there are none).  Null and empty texts have
    no words: such documents have no hits, such items no windows.  An item
    without item_id hits words and is not listed; items that share an item_id
    are listed once.  Rows of ``docs`` that repeat or share a doc_id are rows
    of their own.  Without items nothing is hit; no documents, no rows.  Other
    columns play no part.
    """
    kind = dict(items.dtypes)["item_id"]
    cut = stored(items.select("item_id", "text").mapInArrow(_cut(window), f"item_id {kind}, words string").distinct(), "cut")
    windows = numbered(cut.select("words").distinct().mapInArrow(_shingled(width), "words string, n int, longest long, tokens array<long>"), "window", "windows")
    seen = windows.agg(F.collect_set(F.least("n", F.lit(width))).alias("widths"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest")).first()
    widths = sorted(seen["widths"]) or [width]
    probes = stored(_prefixes(docs, windows, widths), "probes")
    known = _Bitmap(probes.select("token").distinct())
    schema = f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, met array<struct<token: long, at: long, before: int, context: string>>"
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    probed = stored(rows.mapInArrow(_met(known, widths, window, seen["longest"]), schema), "probed")

    places = probed.select("row", F.explode("met").alias("m")).select("row", "m.*").join(probes, "token")
    same = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ") == F.col("words")
    start = F.col("at") - F.col("place")
    found = places.filter("before >= place").filter(same).select("row", "window", start.alias("start"), (start + F.col("n")).alias("end"))
    owners = cut.join(windows.select("window", "words"), "words").select("window", F.col("item_id").cast("string").alias("item"))
    # an item's windows that occur are merged before they are sorted: a span counts from where earlier ones end
    of_row = found.join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reached"))
    more = lambda s, x: F.struct((s.hit + F.greatest(F.lit(0).cast("long"), x.end - F.greatest(x.start, s.reached))).alias("hit"), F.greatest(s.reached, x.end).alias("reached"))
    of_row = of_row.select("row", F.aggregate("spans", none, more)["hit"].alias("hit"), "item_ids")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    joined = probed.select("row", "doc_id", "n_words").join(of_row, "row", "left")
    return joined.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), ids.alias("item_ids"))
