"""Near-duplicate groups by min-max hashing.

Each document is the set of its five-word shingles.  Under every permutation
both the smallest and the largest hash are kept, so ``n`` permutations give
``2 n`` signature values; two of them (a minimum and a maximum each) times
``ROWS / 2`` form a band.  With 4 rows and 20 bands a pair at the limit of
0.85 is missed with probability (1 - 0.85**4)**20, about 4e-7.

Texts with equal sets form one class before any comparison, so copies never
meet in pairs.  Within a bucket two exact steps find the links:

1. every class is compared with the bucket's most central class only;
2. classes still in different components are compared where bounds allow a
   link: sizes within the limit; at most ``n - alone`` shingles shared,
   ``alone`` counting the shingles that no other candidate class has; and at
   least as many shingles on one side only as there are bits in which the
   classes' parity sketches differ (a bit is the parity of the number of
   shingles in its bin, so each such bit needs a shingle of its own).

All links are confirmed on full sets.  No bucket, class or partner is capped;
a bucket's classes of one size level are dealt over as many tasks as they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import numbered, stored
from .shingles import SHINGLE, mix, row_shingles

ROWS = 4
BANDS = 20
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Ratio of the geometric size classes that step 2 joins on.
SIZE_STEP = 1.03
#: Bits of the parity sketch, a multiple of 64.
PARITY_BITS = 512
#: Classes of one bucket and size level that one task of step 2 takes on one side.
PAIR_BLOCK = 2000

_U = np.uint64


def min_max_signatures(hashes: np.ndarray, offsets: np.ndarray, permutations: int, seed: int = 7) -> np.ndarray:
    """[row, 2 * permutations]: minimum and maximum of each row's hashes under each permutation; rows must not be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * _U(2) + _U(1)
    out = np.empty((len(offsets) - 1, 2 * permutations), np.uint64)
    for k, factor in enumerate(factors):
        x = hashes * factor
        out[:, 2 * k] = np.minimum.reduceat(x, offsets[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(x, offsets[:-1])
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """[row, band]: one number for each band's values; different bands never agree by design of the seed."""
    n, width = signatures.shape
    bands = width // rows
    keys = np.empty((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, mix(np.array([b + 1], np.uint64))[0])
        for j in range(rows):
            h = mix(h ^ signatures[:, b * rows + j])
        keys[:, b] = h
    return keys


def set_key(own: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """Size and two digests of a set of hashes: equal for equal sets only."""
    return len(own), mix(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own + _U(0x51ED27)))


def _sketches(rows: int, bands: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hashes, offsets in row_shingles(batch.column("text"), size):
                n = len(offsets) - 1
                counts, first, second = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for i in np.flatnonzero(np.diff(offsets)):
                    counts[i], first[i], second[i] = set_key(np.unique(hashes[offsets[i] : offsets[i + 1]]))
                full = np.flatnonzero(counts)
                keys = np.zeros((0, bands), np.uint64)
                if len(full):
                    edges = np.append(offsets[:-1][full], offsets[-1])
                    keys = band_keys(min_max_signatures(hashes, edges, rows * bands // 2), rows)
                ends = np.concatenate([[0], np.cumsum(counts > 0)]).astype(np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, n),
                        batch.column("doc_id").slice(lo, n),
                        pa.array(counts),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["id", "doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hashes, offsets in row_shingles(batch.column("text"), size):
                own = [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                odd = [np.bincount((x % _U(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1 for x in own]
                bits = np.packbits(np.array(odd, np.uint8).reshape(len(own), PARITY_BITS), axis=1).view(np.int64)
                keyed = [set_key(x) if len(x) else (0, _U(0), _U(0)) for x in own]
                parity_ends = np.arange(len(own) + 1, dtype=np.int32) * bits.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keyed], pa.int64()),
                        pa.array(np.array([k[1] for k in keyed], np.uint64).view(np.int64)),
                        pa.array(np.array([k[2] for k in keyed], np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(parity_ends, pa.int32()), pa.array(bits.ravel())),
                    ],
                    names=["n", "set_a", "set_b", "shingles", "parity"],
                )

    return run


def _may_link(na, nb, most, parity_a, parity_b, percent: int):
    """Whether sets of these sizes can link if they share at most ``most`` shingles and have these parity sketches."""
    apart = sum((F.bit_count(parity_a[i].bitwiseXOR(parity_b[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    shared = F.least(na, nb, most, F.floor((na + nb - apart) / 2))
    return 100 * shared >= percent * (na + nb - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the limit."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_of_b"))
    shared = F.size(F.array_intersect("set_of_a", "set_of_b"))
    union = F.size("set_of_a") + F.size("set_of_b") - shared
    return pairs.join(left, "a").join(right, "b").filter(100 * shared >= percent * union).select("a", "b")


def _components(sketch: DataFrame, texts: DataFrame, percent: int, size: int, by_id: bool) -> DataFrame:
    """(set_a, set_b, n, root) of every class of equal sets of ``sketch`` (id, doc_id, n_shingles, set_a, set_b, keys).

    Classes of one root are linked by their sets or, with ``by_id``, by standing
    under one doc_id.  ``texts`` (id, text) has the rows' texts.
    """
    full = sketch.filter("n_shingles > 0")
    # a third of all rows may be copies: the first row of each class is found before the shuffle
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min_by(F.struct("id", "keys"), "id").alias("first"))
    classes = numbered(classes.select("set_a", "set_b", F.col("n_shingles").alias("n"), F.col("first.id").alias("id"), F.col("first.keys").alias("keys")), "cls", "classes")
    # a doc_id that stands over several sets is one document: its classes belong together
    same = (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & (F.col("n_shingles") == F.col("n"))
    several = full.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).filter("x <> y").select("doc_id")
    over = full.join(several, "doc_id").join(classes.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "n", "cls"), same).select("doc_id", "cls").distinct()
    one_id = over.join(over.groupBy("doc_id").agg(F.min("cls").alias("b")), "doc_id").filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct()

    dealt = classes.select("cls", "n", F.explode("keys").alias("key"))
    shared_keys = dealt.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = stored(dealt.join(shared_keys, "key"), "members")

    candidates = stored(members.groupBy("cls").agg(F.sum("members").alias("weight")), "candidates")
    wanted = stored(candidates.join(classes.drop("keys"), "cls").select("cls", "id", "set_a", "set_b", "n"), "wanted")
    # an id may stand over other texts too: a set is known by its key; ids alone keep the side that meets the texts small
    ids = stored(wanted.select("id"), "ids")
    sets = texts.join(ids, "id", "left_semi").mapInArrow(_sets(size), "n long, set_a long, set_b long, shingles array<long>, parity array<long>")
    sets = stored(sets.dropDuplicates(["set_a", "set_b", "n"]).join(wanted.drop("id"), ["set_a", "set_b", "n"]).select("cls", "shingles", "parity"), "sets")
    only = sets.select("cls", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("holders"), F.min("cls").alias("cls")).filter("holders = 1")
    alone = only.groupBy("cls").agg(F.count("*").alias("alone"))
    candidates = stored(candidates.join(alone, "cls", "left").join(sets.select("cls", "parity"), "cls").select("cls", "weight", F.coalesce("alone", F.lit(0)).alias("alone"), "parity"), "candidates")
    members = stored(members.join(candidates, "cls").select("key", "cls", "n", (F.col("n") - F.col("alone")).alias("most"), "weight", "parity"), "members")

    # step 1: each class against the most central class of its bucket
    centre = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("cls")).alias("minus"), "n", "most", "parity")).alias("c"))
    centre = centre.select("key", (-F.col("c.minus")).alias("p"), F.col("c.n").alias("pn"), F.col("c.most").alias("pmost"), F.col("c.parity").alias("pparity"))
    pairs = members.join(centre, "key").filter("cls <> p").filter(_may_link(F.col("n"), F.col("pn"), F.least("most", "pmost"), F.col("parity"), F.col("pparity"), percent))
    first_links = _confirmed(pairs.select(F.col("cls").alias("a"), F.col("p").alias("b")).distinct(), sets, percent)
    roots = stored(components(first_links.unionAll(one_id) if by_id else first_links, "links"), "roots")

    # step 2: classes still apart, wherever the bound allows a link
    labelled = stored(members.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", "most", "parity", F.coalesce("root", "cls").alias("root")), "labelled")
    apart = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max_by("root", F.struct("most", "cls")).alias("main")).filter("r0 <> r1")
    open_ = labelled.join(apart.select("key", "main"), "key")
    step = float(np.log(SIZE_STEP))
    level = lambda c: F.floor(F.log(c.cast("double")) / F.lit(step)).cast("int")
    n, most = F.col("n"), F.col("most")
    # a partner of size m shares at most s = min(most, m), and percent * (n + m - s) <= 100 * s
    low = F.ceil(n * percent / 100.0)
    high = F.least(F.floor(n * 100.0 / percent), F.floor(most * (100.0 + percent) / percent - n))
    feasible = open_.filter(100 * most >= percent * n)
    levels = F.sequence(level(low) - 1, level(F.greatest(high, low)) + 1)
    side = feasible.filter("root <> main").select("key", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("most").alias("amost"), F.col("root").alias("aroot"), F.col("parity").alias("aparity"), F.explode(F.when(high >= low, levels)).alias("level"))
    other = feasible.select("key", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("most").alias("bmost"), F.col("root").alias("broot"), F.col("parity").alias("bparity"), level(n).alias("level"))
    # a hot bucket is cut into blocks of the one side, each met by all of the other
    blocks = side.groupBy("key", "level").agg(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)).cast("int").alias("blocks"))
    side = side.join(blocks, ["key", "level"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    other = other.join(blocks, ["key", "level"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    more = side.join(other, ["key", "level", "block"]).filter("aroot <> broot").filter(_may_link(F.col("an"), F.col("bn"), F.least("amost", "bmost"), F.col("aparity"), F.col("bparity"), percent))
    more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    more_links = stored(_confirmed(more, sets, percent), "links")
    final = roots
    if not more_links.isEmpty():
        final = components(more_links.unionAll(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")
    return classes.join(final, F.col("cls") == F.col("node"), "left").select("set_a", "set_b", "n", F.coalesce("root", "cls").alias("root"))


def _labelled(sketch: DataFrame, texts: DataFrame, percent: int, size: int, by_id: bool) -> DataFrame:
    """id, doc_id, n_shingles and root (null for empty sets) of every row of ``sketch``."""
    of_class = _components(sketch, texts, percent, size, by_id).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "n", "root")
    same = (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & (F.col("n_shingles") == F.col("n"))
    columns = ("id", "doc_id", "n_shingles", "root")
    found = sketch.filter("n_shingles > 0").join(of_class, same).select(*columns)
    return found.unionAll(sketch.filter("n_shingles = 0").select("id", "doc_id", "n_shingles", F.lit(None).cast("long").alias("root")))


_SKETCH = "id long, doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and wordless texts have an empty set, link with nothing and are kept.
    Texts under ``size`` words count as one shingle.  Rows of one doc_id are
    one document, whatever their texts: what links with one is reachable from
    the others, and each gets its row of the result.  A null doc_id is no
    document: its row links with nothing, component_id is null, and it stays.
    Ties do not arise.  No rows in: no rows out.  Other columns play no part.
    """
    docs = docs.select(F.col("doc_id").alias("id"), "doc_id", "text")
    sketch = stored(docs.mapInArrow(_sketches(rows, bands, size), _SKETCH), "sketch")
    found = stored(_labelled(sketch.filter("doc_id is not null"), docs.filter("doc_id is not null").select("id", "text"), percent, size, True), "labelled")
    least = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    full = found.filter("root is not null").join(least, "root")
    # a row without words is its own, but for one whose id also stands over words
    empty = found.filter("root is null")
    with_words = full.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
    empty = empty.join(with_words, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    columns = ("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    unnamed = sketch.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return full.select(*columns).unionAll(empty.select(*columns)).unionAll(unnamed)


def keep_one(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that of the smallest doc_id (null last); all columns stay.

    Here rows are the documents: a row repeated whole leaves one, rows without
    doc_id are compared like any, and rows of one doc_id with unlike texts all
    stay.  So do rows without words.  Of rows that tie, any one stays.  No rows
    in: no rows out.
    """
    # the rows' number has a name that no column has
    number = "_row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    docs = numbered(docs, number, "rows")
    own = docs.select(F.col(number).alias("id"), "doc_id", "text")
    sketch = stored(own.mapInArrow(_sketches(rows, bands, size), _SKETCH), "sketch")
    found = stored(_labelled(sketch, own.select("id", "text"), percent, size, False).filter("root is not null"), "labelled")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")).alias("first")).select("root", F.col("first.id").alias("first"))
    gone = found.join(first, "root").filter("id <> first").select(F.col("id").alias(number))
    return docs.join(gone, number, "left_anti").drop(number)
