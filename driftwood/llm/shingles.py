"""Word and shingle hashing over Arrow text columns, vectorised in numpy.

Words are maximal runs of bytes outside space and 0x09-0x0D; UTF-8 never uses
those bytes inside a longer character, so splitting bytes equals splitting
code points.  All hashes are unsigned 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part words of letters, digits and whatever is beyond ASCII.
BETWEEN_TERMS = np.ones(256, dtype=bool)
BETWEEN_TERMS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); about ``limit`` bytes at once, or one row."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each row (with the total at the end).  ``between`` marks the bytes that part words."""
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word's bytes, with A-Z folded if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _PLACE[63])


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles of ``size`` words (of all its words, if fewer), and their offsets by row."""
    n_words = np.diff(rows)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(n_words.dtype))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - rows[:-1], counts)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += padded[at + j] * _PLACE[j]
    for i in np.flatnonzero((n_words > 0) & (n_words < size)):
        own = hashes[rows[i] : rows[i + 1]]
        out[offsets[i]] = (int(np.sum(own * _PLACE[: len(own)], dtype=np.uint64)) + int(_PLACE[62]) * len(own)) & 0xFFFFFFFFFFFFFFFF
    return mix(out), offsets


def runs(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of exactly ``size`` words inside a row, and the word each begins at."""
    counts = np.maximum(np.diff(rows) - size + 1, 0)
    first = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    out = np.full(len(first), _PLACE[50 + size], np.uint64)
    for j in range(size):
        out += hashes[first + j] * _PLACE[j]
    return mix(out), first


def row_shingles(column: pa.Array, size: int = SHINGLE, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of rows: the first row, the shingle hashes and their offsets."""
    for lo, _, data, offsets in text_chunks(column):
        starts, ends, rows = words(data, offsets)
        hashes, at = shingle_hashes(word_hashes(data, starts, ends, lower), rows, size)
        yield lo, hashes, at
