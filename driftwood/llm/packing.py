"""Best-fit packing of token sequences, hierarchically.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Pieces are dealt into groups of bounded size; each group is packed best-fit in
order of falling length.  Bins that are nearly full, or that no other item of
the level fits into, are final; the others go on as items of the next level,
dealt anew into fewer groups of the same bounded size, where best-fit fills
them with each other.  Rounds end when one group held all items, or when a
round over groups that bounded size does not let shrink saves less than
LEAST_SAVED of its bins.  An item keeps its bin and place only; places in
sequences follow by going up the levels.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

CAPACITY = 1024
#: Id appended to every document.
END_ID = 2
#: Items that one task packs at once, about.
GROUP_ITEMS = 40_000
#: Levels merge so many groups into one.
FAN_IN = 8
#: A bin is final when at least this share is filled.
NEARLY_FULL = 0.995
#: A round that saves less than this share of its items is the last.
LEAST_SAVED = 0.001

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = "byte_bpe_50k"):
    """text -> ids.  The rank file holds the vocabulary of the tokenizer's json and gives the same ids, faster.

    Its pattern runs out of stack on a run of about a million blanks; such a
    text is encoded by the tokenizer itself.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    coder = _encoders[vocabulary]

    def encode(text: str) -> list[int]:
        try:
            return coder.encode(text, allowed_special="all")
        except ValueError:
            return _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids

    return encode


def _tokenizer(vocabulary: str):
    key = f"{vocabulary}.json"
    if key not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoders[key] = Tokenizer.from_file(public_tokenizers.path(key))
    return _encoders[key]


def piece_edges(n: int, capacity: int) -> list[int]:
    """Where a document of ``n`` tokens is cut: every piece but the first is full."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def _pieces(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids_of = part.column("doc_id").to_pylist()
                rows: list[list] = [[], [], [], [], [], []]
                for row, (doc_id, text) in enumerate(zip(ids_of, pc.fill_null(part.column("text"), "").to_pylist())):
                    ids = np.array([*encode(text), END_ID], dtype="<u4")
                    edges = piece_edges(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        data = ids[a:b].tobytes()
                        for column, x in zip(rows, (doc_id, k, a, b - a, zlib.crc32(data), ids[a:b].tolist() if with_ids else None)):
                            column.append(x)
                arrays = [pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=names[: 5 + with_ids])

    return run


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text; null text is empty, and so one end id)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity, with_ids), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items in each bin: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def _pack(capacity: int):
    """item, bin (the item that stands first in it), offset in the bin and the bin's length, for a group's items."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        items, lengths = table.column("item").to_numpy(), table.column("length").to_numpy()
        bins = best_fit(lengths.tolist(), capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        sizes = np.array([len(b) for b in bins], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64)
        start, end = before[first], before[first + sizes]
        return pa.table({"item": items[order], "bin": np.repeat(items[order[first]], sizes), "offset": before[:-1] - np.repeat(start, sizes), "filled": np.repeat(end - start, sizes)})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN, least_saved: float = LEAST_SAVED) -> DataFrame:
    """``pieces`` (item long, unique; length) with sequence_id and offset, as item, sequence_id, offset.

    Pieces of full length are sequences of their own.  A sequence is numbered
    by its first item.  Groups are dealt by the item's hash, so no length,
    document or source can crowd one task, and a group has about
    ``group_items`` items at most at every level.
    """
    whole = pieces.filter(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level = pieces.filter(F.col("length") < capacity).select("item", "length")
    count, levels = level.count(), []
    groups = max(1, -(-count // group_items))
    while count:
        keyed = level.withColumn("group", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(groups)))
        placed = stored(keyed.groupBy("group").applyInArrow(_pack(capacity), "item long, bin long, offset long, filled long"), "level")
        levels.append(placed)
        if groups == 1:
            break
        bins = placed.filter("item = bin").select("item", F.col("filled").alias("length"))
        least = bins.agg(F.min("length")).first()[0]
        level = bins.filter((F.col("length") < int(capacity * NEARLY_FULL)) & (F.col("length") + least <= capacity))
        left = level.count()
        fewer = max(1, -(-groups // fan_in), -(-left // group_items))
        if left > (1 - least_saved) * count and fewer == groups:
            break
        count, groups = left, min(groups, fewer)
    if not levels:
        return whole
    # from the last level down: a bin that went on has its place in the level above
    spots = levels[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for placed in reversed(levels[:-1]):
        above = spots.select(F.col("item").alias("bin"), F.col("sequence_id").alias("over"), F.col("offset").alias("base"))
        spots = placed.join(above, "bin", "left").select("item", F.coalesce("over", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    return whole.unionAll(spots)


def packed_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Every piece of ``docs`` with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty text: one piece of the end id.  Rows that repeat, share
    a doc_id or have none are packed each: a piece is known by a number of its
    own.  Items of one length go by that number.  No rows in: no rows out.
    Other columns play no part.  With ``with_ids`` the ids come along.
    """
    pieces = numbered(token_pieces(docs, vocabulary, capacity, with_ids), "item", "pieces")
    spots = pack(pieces.select("item", "length"), capacity, group_items, fan_in)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return pieces.join(spots, "item").select(*columns, "sequence_id", "offset")
