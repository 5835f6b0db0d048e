"""Words that count only in a fitting context: a hit is cancelled by another that lies close around it."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .tagging import HELD_HITS, MOST_LETTERS, occurrences, pieces

#: Characters on either side of a word in which a cancelling word counts.
AROUND = 8
WORD, NEGATIVE, CONTEXT = "WORD", "NEGATIVE", "CONTEXT"


def cancelled_by(span: tuple[int, int], others: Sequence[tuple[int, int, int]], around: int) -> int | None:
    """The least rank of ``others`` (start, end, rank; sorted) that lie whole within ``around`` characters of the span; None if none does."""
    low, high = span[0] - around, span[1] + around
    found = None
    for start, end, rank in others[bisect.bisect_left(others, (low, low, -1)) :]:
        if start >= high:
            break
        if end <= high and (found is None or rank < found):
            found = rank
    return found


def _judged(labels: Mapping[int, tuple[str, str, int, str]], around: int, types: pa.Schema):
    """Per text and label: the word that shows it, or the word and what cancelled it; some texts' hits at a time."""

    def judge(hits) -> Iterator[tuple[str, str, str | None]]:
        spans: dict[str, dict[str, list]] = {}
        context = False
        for hit in hits:
            label, role, rank, _ = labels[hit["pattern"]]
            context = context or role == CONTEXT
            if role != CONTEXT:
                spans.setdefault(label, {WORD: [], NEGATIVE: []})[role].append((hit["start"], hit["end"], rank, hit["pattern"]))
        for label in sorted(spans):
            words = sorted(spans[label][WORD], key=lambda h: (h[2], h[0]))
            negatives = sorted(h[:3] for h in spans[label][NEGATIVE])
            named = {h[2]: labels[h[3]][3] for h in spans[label][NEGATIVE]}
            clean = wrapped = None
            for start, end, _, pattern in words:
                near = cancelled_by((start, end), negatives, around)
                if near is None:
                    clean = labels[pattern][3]
                    break
                wrapped = wrapped or (labels[pattern][3], named[near])
            if clean is not None and not context and negatives:
                clean, wrapped = None, (clean, named[min(h[2] for h in negatives)])
            if clean is not None:
                yield label, clean, None
            elif wrapped:
                yield label, *wrapped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "hits", HELD_HITS):
                rows = [(key, *found) for key, hits in zip(some.column("key").to_pylist(), some.column("hits").to_pylist()) for found in judge(hits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.types)], schema=types)

    return run


def labels_in_context(texts: DataFrame, words: DataFrame, around: int = AROUND, most_letters: int = MOST_LETTERS) -> DataFrame:
    """key, label, word, cancelled_by of ``texts`` (key, text): the labels that a text's words show, and those it only seems to.

    ``words`` has label, role, rank and word: words of a label (WORD), words
    that cancel its words when they lie whole within ``around`` characters
    (NEGATIVE), and words of no label that speak for any (CONTEXT).  Case aside,
    words occur anywhere.  The first word by rank, then place, that nothing
    cancels shows the label.  In a text without any CONTEXT word a NEGATIVE
    anywhere cancels it too.  A label of which all words are cancelled comes
    with the first word and the first that cancels it; one without words not at
    all.  A word of no letters is left out.  The table of words is a scene's
    vocabulary and rides with the tasks; texts meet it through one automaton.
    """
    lowered = words.filter("word <> ''").select("label", "role", "rank", "word", F.lower("word").alias("letters"))
    rows = [tuple(r) for r in lowered.orderBy("label", "role", "rank", "word").collect()]
    labels = {k: (label, role, rank, word) for k, (label, role, rank, word, _) in enumerate(rows)}
    patterns = texts.sparkSession.createDataFrame([(k, r[4], None) for k, r in enumerate(rows)], "pattern long, letters string, scope string")
    found = occurrences(texts.select("key", F.lower("text").alias("text")), patterns, False, most_letters, True)
    schema = StructType([texts.schema["key"], *(StructField(c, StringType()) for c in ("label", "word", "cancelled_by"))])
    return found.select("key", "hits").mapInArrow(_judged(labels, around, to_arrow_schema(schema)), schema)
