"""License scans: minhash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits in lower case.  Templates are of two
sizes, and texts are read in windows of both:

- notices of a line: windows of 8 words, each overlapping the next by four, so
  every five-word shingle lies in exactly one.  A band is one minhash value: a
  lone shared shingle of four (J = 1/4) is met with probability
  1 - (3/4)^32 = 0.9999;
- whole licenses: windows of 32 words that overlap by half, in bands of two
  values.  A template is indexed by its windows at every word, so an unchanged
  window of a copy meets it for sure, and one with a word exchanged
  (J = 23/33) with probability 1 - (1 - J^2)^20 = 0.999999.

Templates met are then held against the text's shingles exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import SHINGLE, mix, shingle_hashes, text_chunks, word_hashes, words

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."

# Whole texts of well-known licenses, and openings and notices of these and others.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
}


class Scale(NamedTuple):
    """Windows of so many shingles, the next one so many on, in so many bands of so many values; for templates from so many shingles on."""

    window: int
    step: int
    bands: int
    rows: int
    from_shingles: int


SCALES = (Scale(4, 4, 32, 1, 1), Scale(28, 14, 20, 2, 28))
#: A template is found where this share of its shingles stands together.
CONTAINED = 0.8
#: Shingles of one find lie no further apart than so many words, or this share of the template's.
GAP = 12
GAP_SHARE = 0.2

_U = np.uint64
_CLEAN = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _CLEAN[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def _shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = _CLEAN[data]
    starts, ends, rows = words(data, offsets)
    hashes, at = shingle_hashes(word_hashes(data, starts, ends), rows)
    return hashes, at, starts, ends, rows


class Bands:
    """The band values of templates' windows at one scale, with a filter on their low bits."""

    def __init__(self, sets: list[tuple[int, np.ndarray]], scale: Scale, seed: int):
        self.scale = scale
        self.factors = np.random.default_rng(seed).integers(1, 1 << 63, (scale.bands, scale.rows), dtype=np.uint64) * _U(2) + _U(1)
        found: list[dict[int, set[int]]] = [{} for _ in range(scale.bands)]
        for k, hashes in sets:
            first = np.arange(max(1, len(hashes) - scale.window + 1))
            for b, values in enumerate(self._values(hashes, first, np.minimum(first + scale.window, len(hashes)))):
                for v in values.tolist():
                    found[b].setdefault(v, set()).add(k)
        self.owners = found
        self.low = np.zeros((scale.bands, 1 << 16), bool)
        for b, owners in enumerate(found):
            self.low[b, np.array([v & 0xFFFF for v in owners], np.int64)] = True

    def _values(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
        """For each band: the value of every window from ``first`` to ``last`` (exclusive)."""
        edges = np.stack([first, last], axis=1).ravel()
        padded = np.append(hashes, _U(0xFFFFFFFFFFFFFFFF))
        for factors in self.factors:
            value = np.zeros(len(first), np.uint64)
            for factor in factors:
                x = padded * factor
                x[-1] = _U(0xFFFFFFFFFFFFFFFF)
                value = mix(value ^ np.minimum.reduceat(x, edges)[::2])
            yield value

    def met(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, set[int]]]:
        """(row, templates met) for rows of shingle hashes, by offsets, in any band of any window."""
        counts = np.diff(at)
        windows = np.where(counts > 0, np.maximum(0, -(-(counts - self.scale.window) // self.scale.step)) + 1, 0)
        row = np.repeat(np.arange(len(counts)), windows)
        first = at[:-1][row] + (np.arange(len(row)) - (np.cumsum(windows) - windows)[row]) * self.scale.step
        if not len(first):
            return
        for b, values in enumerate(self._values(hashes, first, np.minimum(first + self.scale.window, at[1:][row]))):
            for w in np.flatnonzero(self.low[b, (values & _U(0xFFFF)).astype(np.int64)]):
                owners = self.owners[b].get(int(values[w]))
                if owners:
                    yield int(row[w]), owners


class Index:
    """Templates' shingles, and their windows' band values at every scale."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, scales: tuple[Scale, ...] = SCALES, seed: int = 11):
        self.names = [name for name, texts in sorted(templates.items()) for _ in texts]
        own = []
        for text in (t for _, texts in sorted(templates.items()) for t in texts):
            data = np.frombuffer(text.encode(), np.uint8)
            own.append(_shingled(data, np.array([0, len(data)]))[0])
        self.sets = [np.unique(h) for h in own]
        self.bands = []
        for n, scale in enumerate(scales):
            most = min((s.from_shingles for s in scales if s.from_shingles > scale.from_shingles), default=1 << 62)
            fitting = [(k, h) for k, h in enumerate(own) if scale.from_shingles <= len(h) < most]
            if fitting:
                self.bands.append(Bands(fitting, scale, seed + n))

    def met(self, hashes: np.ndarray, at: np.ndarray) -> dict[int, set[int]]:
        """Templates met by each row (rows of shingle hashes, by offsets) at any scale."""
        out: dict[int, set[int]] = {}
        for bands in self.bands:
            for row, owners in bands.met(hashes, at):
                out.setdefault(row, set()).update(owners)
        return out

    def spans(self, own: np.ndarray, templates: set[int], share: float) -> list[tuple[str, int, int]]:
        """(name, first word, last word + 1) where a met template's shingles stand together in a row's shingles."""
        found = []
        for k in sorted(templates):
            hits = np.flatnonzero(np.isin(own, self.sets[k]))
            if not len(hits):
                continue
            for run in np.split(hits, np.flatnonzero(np.diff(hits) > max(GAP, GAP_SHARE * len(self.sets[k]))) + 1):
                if len(np.unique(own[run])) >= share * len(self.sets[k]):
                    found.append((self.names[k], int(run[0]), int(run[-1]) + SHINGLE))
        return found


def find_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, scales: tuple[Scale, ...] = SCALES, share: float = CONTAINED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_licenses, licenses (names, sorted), spans (name:start:end by start).

    Whole texts are scanned; offsets are code points, end exclusive.  Finds of
    one license that overlap count once; spans that tie in start go by end, then
    name.  Null, empty and short texts have none.  Repeated rows repeat; other
    columns play no part.  No rows in: no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, scales)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                hashes, at, starts, ends, rows = _shingled(data, offsets)
                names, spans = [""] * (hi - lo), [""] * (hi - lo)
                counts = [0] * (hi - lo)
                for row, templates_met in index.met(hashes, at).items():
                    found = index.spans(hashes[at[row] : at[row + 1]], templates_met, share)
                    if not found:
                        continue
                    n = rows[row + 1] - rows[row]
                    begins = (data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80
                    point = np.concatenate([[0], np.cumsum(begins)])
                    placed: list[tuple[int, int, str]] = []
                    for name, a, b in sorted(found, key=lambda f: (f[0], f[1], -f[2])):
                        a, b = rows[row] + a, rows[row] + min(b, n) - 1
                        span = int(point[starts[a] - offsets[row]]), int(point[ends[b] - offsets[row]])
                        if placed and placed[-1][2] == name and span[0] < placed[-1][1]:
                            placed[-1] = (placed[-1][0], max(placed[-1][1], span[1]), name)
                        else:
                            placed.append((*span, name))
                    counts[row] = len(placed)
                    names[row] = ",".join(sorted({p[2] for p in placed}))
                    spans[row] = ",".join(f"{name}:{a}:{b}" for a, b, name in sorted(placed))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(names), pa.array(spans)], names=["doc_id", "n_licenses", "licenses", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_licenses long, licenses string, spans string")
