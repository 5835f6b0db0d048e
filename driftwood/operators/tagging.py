"""Terms of a table found in texts, with their places, and what they make of an event.

All terms are searched at once by an automaton.  Where hits overlap the
longest stays.  A table of up to MOST_LETTERS letters rides to every task; a
larger one is dealt into parts, and blocks of texts meet each part.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Letters of the terms that one automaton holds, of the texts in a block that meets a part of them, and of texts whose hits are held at once.
MOST_LETTERS = 1 << 20
BLOCK_LETTERS = 1 << 24
HELD_LETTERS = 1 << 20
#: Hits that are held as Python objects at once.
HELD_HITS = 1 << 16

_HIT = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("pattern", LongType()), StructField("scope", StringType())]))
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int64()), ("scope", pa.string())]))
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _automaton(rows: Sequence[tuple]):
    """An automaton of (pattern, letters, scope): letters of several patterns are one entry."""
    import ahocorasick

    by_letters: dict[str, list] = {}
    for pattern, letters, scope in rows:
        by_letters.setdefault(letters, []).append((pattern, scope))
    found = ahocorasick.Automaton()
    for letters, owners in by_letters.items():
        found.add_word(letters, (len(letters), letters.isascii(), owners))
    found.make_automaton()
    return found


def _spans(automaton, text: str | None, whole_words: bool, overlapping: bool) -> Iterator[tuple[int, int, list]]:
    """Every term's occurrences as start, end and owners, left to right by end; without overlaps of its own unless ``overlapping``."""
    free: dict[int, int] = {}
    if not text or not len(automaton):
        return
    for last, (size, latin, owners) in automaton.iter(text):
        start, end = last + 1 - size, last + 1
        if whole_words and latin and (text[max(start - 1, 0) : start] in _LATIN or text[end : end + 1] in _LATIN):
            continue
        if overlapping or free.get(id(owners), 0) <= start:
            free[id(owners)] = end
            yield start, end, owners


def _hits(automaton, texts: list[str | None], whole_words: bool, overlapping: bool) -> pa.Array:
    """The hits of each text, held as columns of numbers."""
    starts, ends, patterns, scopes, offsets = array("i"), array("i"), array("q"), [], array("i", [0])
    for text in texts:
        for start, end, owners in _spans(automaton, text, whole_words, overlapping):
            for pattern, scope in owners:
                starts.append(start)
                ends.append(end)
                patterns.append(pattern)
                scopes.append(scope)
        offsets.append(len(starts))
    fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(patterns, pa.int64()), pa.array(scopes, pa.string())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_HITS.value_type)))


def pieces(batch: pa.RecordBatch, weigh: str = "text", most: int = HELD_LETTERS) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows, each of ``most`` letters (or items, of a list) at most or a single row: one row may make many hits."""
    column = batch.column(weigh)
    sizes = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.utf8_length(column), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def _weight(patterns: DataFrame) -> int:
    """Letters of a table; a row counts for a few besides its own, as many short terms weigh too."""
    return patterns.agg(F.coalesce(F.sum(F.length("letters") + 16), F.lit(0))).first()[0]


def occurrences(texts: DataFrame, patterns: DataFrame, whole_words: bool = True, most_letters: int = MOST_LETTERS, overlapping: bool = False) -> DataFrame:
    """``texts`` (key, text and more) with hits: array of (start, end, pattern, scope), places in code points.

    ``patterns`` has pattern (long), letters and scope (string or null).  Letters
    are compared as they are; fold both sides alike.  With ``whole_words`` a
    Latin pattern stands between other characters than a-z and 0-9; a pattern
    overlaps itself only if ``overlapping``.  Patterns without letters hit nothing; texts without hits have empty arrays.  Keys
    should be unique.
    """
    patterns = patterns.filter("letters <> ''").select(F.col("pattern").cast("long").alias("pattern"), "letters", F.col("scope").cast("string").alias("scope"))
    weight = _weight(patterns)
    if weight <= most_letters:
        rows = [tuple(r) for r in patterns.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(rows)
            for batch in batches:
                for some in pieces(batch):
                    yield some.append_column("hits", _hits(automaton, some.column("text").to_pylist(), whole_words, overlapping))

        return texts.mapInArrow(run, StructType(texts.schema.fields + [StructField("hits", _HIT)]))

    parts = -(-weight // most_letters)
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_LETTERS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = texts.select("key", "text").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = patterns.withColumn("part", F.pmod(F.xxhash64("letters"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def search(group: tuple, some: pa.Table, terms: pa.Table) -> pa.Table:
        automaton = _automaton(list(zip(*(terms.column(c).to_pylist() for c in ("pattern", "letters", "scope")))))
        return pa.table({"key": some.column("key"), "hits": _hits(automaton, some.column("text").to_pylist(), whole_words, overlapping)})

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, StructType([texts.schema["key"], StructField("hits", _HIT)]))
    return texts.join(met.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits")), "key")


def _longest(spans: Iterable[tuple[int, int, int]], size: int) -> list[dict]:
    """Of (start, end, pattern), each span once, those that stay, longest first, ties to the earlier; a pattern once, with its first place and rank.

    What stays is as long as what comes after it, so a later span that overlaps it has an end of its own inside.
    """
    taken = bytearray(size)
    once: dict[int, dict] = {}
    rank = 0
    for start, end, pattern in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if not taken[start] and not taken[end - 1]:
            taken[start:end] = b"\1" * (end - start)
            hit = once.setdefault(pattern, {"pattern": pattern, "start": start, "rank": rank})
            hit["start"] = min(hit["start"], start)
            rank += 1
    return list(once.values())


_CHOSEN = pa.list_(pa.struct([("pattern", pa.int64()), ("start", pa.int32()), ("rank", pa.int32())]))


def chosen_terms(texts: DataFrame, patterns: DataFrame, most_letters: int = MOST_LETTERS) -> DataFrame:
    """key, chosen of ``texts`` (key, text, of): the patterns whose whole-word hits stay, longest first, with first place and rank.

    A text sees patterns of the scope ``of``, or all if that is null.  Of equal
    letters the least pattern is meant.  With a table that rides along, hits never leave the task that finds them.
    """
    found = StructType([texts.schema["key"], StructField("chosen", ArrayType(StructType([StructField("pattern", LongType()), StructField("start", IntegerType()), StructField("rank", IntegerType())])))])
    patterns = patterns.filter("letters <> ''")
    weight = _weight(patterns)
    if weight > most_letters:

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in pieces(batch, "hits", HELD_HITS):
                    out = []
                    for size, of, hits in zip(*(some.column(c).to_pylist() for c in ("size", "of", "hits"))):
                        least: dict[tuple[int, int], int] = {}
                        for h in hits:
                            if of is None or h["scope"] == of:
                                span = h["start"], h["end"]
                                least[span] = min(h["pattern"], least.get(span, h["pattern"]))
                        out.append(_longest(((*span, p) for span, p in least.items()), size or 0))
                    yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(out, _CHOSEN)], ["key", "chosen"])

        seen = occurrences(texts, patterns, True, most_letters)
        return seen.select("key", F.length("text").alias("size"), "of", "hits").mapInArrow(choose, found)
    rows = [tuple(r) for r in patterns.select(F.col("pattern").cast("long"), "letters", F.col("scope").cast("string")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(rows)
        least: dict[tuple[int, str | None], int | None] = {}

        def meant(owners: list, of: str | None) -> int | None:
            at = id(owners), of
            if at not in least:
                least[at] = min((p for p, scope in owners if of is None or scope == of), default=None)
            return least[at]

        for batch in batches:
            for some in pieces(batch):
                out = []
                for text, of in zip(some.column("text").to_pylist(), some.column("of").to_pylist()):
                    spans = ((start, end, meant(owners, of)) for start, end, owners in _spans(automaton, text, True, False))
                    out.append(_longest((s for s in spans if s[2] is not None), len(text or "")))
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(out, _CHOSEN)], ["key", "chosen"])

    return texts.select("key", "text", "of").mapInArrow(run, found)


@F.pandas_udf(StringType())
def normal_term(values: pd.Series) -> pd.Series:
    """NFKC, blanks squeezed and stripped, lower case: the form in which terms and titles are compared."""
    import re
    import unicodedata

    return values.map(lambda v: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v or "")).strip().lower())


def _in_order(formats: Column, order: Sequence[str]) -> Column:
    """Distinct formats: those of ``order`` in that order, then others by name."""
    known = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    return F.concat(F.filter(known, lambda f: F.array_contains(formats, f)), F.array_sort(F.array_except(formats, known)))


def tagged(texts: DataFrame, terms: DataFrame, order: Sequence[str] = (), most_letters: int = MOST_LETTERS) -> DataFrame:
    """``texts`` (key, text, genre) as key, term, terms, formats, term_ids, matches: the terms a text uses.

    ``terms`` has term_id, term, formats, enabled and genre; a text of a genre
    sees that genre's terms, one without sees all.  Of overlapping hits the
    longest stays (ties: the earlier, then by letters, then the lower id); all
    that remain count.  ``term`` is the longest of them, ``terms`` each once in
    order of the text, ``formats`` all theirs in ``order``, ``matches`` structs
    of term_id, term and formats.  Terms without formats or not enabled, and
    terms and texts that fold to nothing, take no part.  A text without hits has
    null term and empty arrays.  Rows of one key should be one.
    """
    live = terms.filter("enabled and size(formats) > 0").select("term_id", "term", "formats", "genre", normal_term("term").alias("letters"))
    folded = texts.select("key", normal_term("text").alias("text"), F.col("genre").alias("of"))
    chosen = chosen_terms(folded, live.select(F.col("term_id").alias("pattern"), "letters", F.col("genre").alias("scope")), most_letters)
    once = chosen.select("key", F.explode_outer("chosen").alias("hit"))
    named = once.select("key", F.col("hit.rank").alias("rank"), F.col("hit.start").alias("start"), F.col("hit.pattern").alias("term_id")).join(live.select("term_id", "term", "formats"), "term_id", "left")
    ordered = named.withColumn("formats", _in_order(F.col("formats"), order))
    per_term = ordered.groupBy("key", "term_id").agg(F.min(F.struct("start", "term_id", "term", "formats")).alias("m"), F.min("rank").alias("rank"))
    some = F.col("m.term_id").isNotNull()
    per_text = per_term.groupBy("key").agg(F.min_by("m.term", "rank").alias("term"), F.array_sort(F.collect_list(F.when(some, F.col("m")))).alias("matches"))
    formats = _in_order(F.flatten(F.col("matches.formats")), order)
    bare = F.transform("matches", lambda m: F.struct(m.term_id.alias("term_id"), m.term.alias("term"), m.formats.alias("formats")))
    return per_text.select("key", "term", F.col("matches.term").alias("terms"), formats.alias("formats"), F.col("matches.term_id").alias("term_ids"), bare.alias("matches"))


@dataclass(frozen=True)
class Kinds:
    """What a scene calls things: formats in order, the format of each event type, labels, and formats that a type's format covers."""

    order: Sequence[str] = ("EVENING", "PRACTICE", "GENERAL", "SOCIAL")
    of_type: Mapping[str, str] = field(default_factory=lambda: {"EVENING": "EVENING", "EVENING_WITH_CLASS": "EVENING", "PRACTICE": "PRACTICE", "GENERAL": "GENERAL", "SOCIAL": "SOCIAL", "PARTY": "SOCIAL"})
    covers: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"EVENING": ("EVENING", "PRACTICE")})
    type_labels: Mapping[str, str] = field(default_factory=dict)
    format_labels: Mapping[str, str] = field(default_factory=dict)
    period: str = "FESTIVAL"
    unknown: str = "UNKNOWN"


def kinds(events: DataFrame, scene: Kinds) -> DataFrame:
    """``events`` (key, event_type, stored, matches, term, formats) with display, kind_formats, certainty, uncertain and reasons.

    In this order: a festival is what its record says; terms of the title
    decide, unsure where no single term covers all formats named or the
    record's type allows none; then formats stored before; then the type; else
    nothing is known.
    """
    type_ = F.nullif(F.upper(F.trim("event_type")), F.lit(""))
    lookup = lambda table, key, other: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], other)
    format_ = lookup(scene.of_type, type_, F.lit(scene.unknown))
    type_label, format_label = lookup(scene.type_labels, type_, type_), lambda f: lookup(scene.format_labels, f, f)
    none = F.array().cast("array<string>")
    formats = F.coalesce("formats", none)
    matched = F.size(F.coalesce("matches", F.array().cast(dict(events.dtypes)["matches"]))) > 0
    covering = F.filter("matches", lambda m: F.size(F.array_except(formats, m.formats)) == 0)
    agrees = (format_ == scene.unknown) | F.array_contains(formats, format_)
    for type_format, allowed in scene.covers.items():
        agrees = agrees | ((format_ == type_format) & (F.size(F.array_except(formats, F.array(*map(F.lit, allowed)))) == 0))
    disagree = F.size(covering) == 0
    doubts = F.array_compact(F.array(F.when(disagree, "TERMS_DISAGREE"), F.when(disagree & (F.size(formats) > 1), "NO_MIXED_TERM"), F.when(~agrees, "ENGINE_DISAGREES")))
    unsure = F.size(doubts) > 0
    stored = _in_order(F.coalesce("stored", none), scene.order)
    has_stored, typed, period = F.size(stored) > 0, format_ != scene.unknown, F.coalesce(type_ == scene.period, F.lit(False))
    longest_covers = F.exists(covering, lambda m: m.term == F.col("term"))
    shown = F.when(unsure, F.array_join("matches.term", " · ")).when(longest_covers, F.col("term")).otherwise(F.get(covering, F.lit(0))["term"])
    by_case = lambda *cases: F.when(period, cases[0]).when(matched, cases[1]).when(has_stored, cases[2]).when(typed, cases[3]).otherwise(cases[4])
    display = by_case(type_label, shown, F.array_join(F.transform(stored, format_label), " + "), type_label, F.coalesce(lookup(scene.type_labels, type_, F.lit(None)), format_label(F.lit(scene.unknown))))
    certainty = by_case(F.lit("ENGINE"), F.when(unsure, "AMBIGUOUS").otherwise("CONFIRMED"), F.lit("STORED"), F.lit("ENGINE"), F.lit("UNRESOLVED"))
    reasons = by_case(
        F.array(F.lit("ENGINE_TYPE")),
        F.concat(F.transform("matches", lambda m: F.concat(F.lit("TERM_MATCH "), m.term)), doubts),
        F.array(F.lit("STORED_FORMATS")),
        F.array(F.lit("NO_TERM"), F.lit("ENGINE_TYPE")),
        F.array(F.lit("NO_TERM"), F.when(type_.isNotNull(), "ENGINE_NOT_A_FORMAT").otherwise("ENGINE_NONE")),
    )
    kind_formats = by_case(none, formats, stored, F.array(format_), none)
    return events.withColumns({"display": display, "kind_formats": kind_formats, "certainty": certainty, "uncertain": certainty.isin("AMBIGUOUS", "UNRESOLVED"), "reasons": reasons})
