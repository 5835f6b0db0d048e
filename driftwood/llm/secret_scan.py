"""Secret scans by grammar inference.

Three base patterns find labelled credentials.  A bounded sample of them, one
set for each kind, becomes a prefix tree over character classes with counts;
states whose outgoing frequencies agree within a Hoeffding bound are merged
into a probabilistic automaton.  Tokens of other places teach one more
automaton in the same way: what ordinary tokens look like.

Then every run of token characters, of any length, is scored.  It is reported
where an automaton can write it, finds it typical (its mean cost lies near
what the automaton's own steps lead to expect, on either side), needs so many
bits to write it that it could not be guessed, and gives it so much more
likelihood than the ordinary tokens do that it outweighs how rare unlabelled
credentials are.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import text_chunks

# The base patterns, in the order of their kinds, and the least length of each (of group 2 for assign).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "format")

_BASE = (("assign", re.compile(ASSIGN, re.ASCII | re.IGNORECASE), 2), ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), 0), ("hex", re.compile(r"[0-9a-f]{24,}"), 0))
#: A quick test on bytes that no text with a base match fails.
_MAY_HOLD = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
#: Candidates are all runs of these bytes.
TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The automata are learnt from about so many labelled credentials of each kind.
SAMPLE = 600
#: Fewer teach nothing.
SAMPLE_LEAST = 8
#: Confidence of the test that keeps states apart.
ALPHA = 0.02
#: Ordinary tokens are learnt from about so many documents, picked by hash, and so many tokens of each, evenly spaced.
ORDINARY_DOCS = 300
ORDINARY_TOKENS = 40
#: A candidate's mean cost lies at most so many deviations from the expected one.
DEVIATIONS = 2.5
#: Unlabelled credentials are held to be one token in so many.
RARITY = 1e6

#: A credential takes so many bits to write, by the automaton's steps and the characters of each class.
LEAST_BITS = 56

# Symbols by byte: digit, a-f, other lower case, A-F, other upper case, and each mark by itself.
_SYMBOLS = "0hlHU+/_=-."
_SYMBOL = np.full(256, len(_SYMBOLS), np.int64)
for _c in range(33, 127):
    _s = "0" if 48 <= _c <= 57 else "h" if 97 <= _c <= 102 else "l" if 103 <= _c <= 122 else "H" if 65 <= _c <= 70 else "U" if 71 <= _c <= 90 else chr(_c)
    if _s in _SYMBOLS:
        _SYMBOL[_c] = _SYMBOLS.index(_s)
#: Bits that tell the characters of a symbol apart.
_WITHIN = np.log2(np.array([10, 6, 20, 6, 20] + [1] * (len(_SYMBOLS) - 4)))
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[list(TOKEN_BYTES)] = True


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of every base match: leftmost, without overlap in a kind, too short ones dropped."""
    return [(kind, m.start(), m.end(), m[group]) for kind, pattern, group in _BASE for m in pattern.finditer(text) if len(m[group]) >= LEAST[kind]]


def symbols(value: str) -> str:
    """Character classes: digit, a-f, other lower case, A-F, other upper case; anything else is itself."""
    return "".join("0" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "H" if "A" <= c <= "F" else "U" if "G" <= c <= "Z" else c for c in value)


@dataclass
class Automaton:
    """steps[state][symbol] = (next state, log probability), ends[state] = log probability of stopping; mean and deviation of a step's among the labelled."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    mean: float = 0.0
    deviation: float = 0.0

    def costs(self, value: str) -> list[float]:
        """Log probability of each symbol and of the end; what follows a step never seen costs as much as a rare one."""
        state, out = 0, []
        for c in value:
            step = self.steps[state].get(c)
            if step is None:
                return out + [_UNSEEN] * (len(value) + 1 - len(out))
            state, p = step
            out.append(p)
        return [*out, self.ends[state]]

    def score(self, value: str) -> float:
        """Mean log probability of a symbol."""
        return sum(self.costs(value)) / (len(value) + 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log probability by state and symbol, and of stopping; the last state is that of steps never seen."""
        n, width = len(self.steps), len(_SYMBOLS) + 1
        following, cost = np.full((n + 1, width), n, np.int64), np.full((n + 1, width), _UNSEEN)
        for state, steps in enumerate(self.steps):
            for c, (to, p) in steps.items():
                following[state, _SYMBOLS.index(c)], cost[state, _SYMBOLS.index(c)] = to, p
        return following, cost, np.array([*self.ends, _UNSEEN])


_UNSEEN = math.log(1e-4)


def infer(samples: list[str], alpha: float = ALPHA) -> Automaton:
    """An automaton from strings of symbols, by merging compatible states of their prefix tree (red-blue order)."""
    children: list[dict[str, int]] = [{}]
    counts: list[dict[str, int]] = [{}]
    arrived, ended = [0], [0]
    for value in samples:
        state = 0
        arrived[0] += 1
        for c in value:
            counts[state][c] = counts[state].get(c, 0) + 1
            if c not in children[state]:
                children[state][c] = len(children)
                children.append({})
                counts.append({})
                arrived.append(0)
                ended.append(0)
            state = children[state][c]
            arrived[state] += 1
        ended[state] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ended[a], arrived[a], ended[b], arrived[b]):
                return False
            for c in counts[a].keys() | counts[b].keys():
                if differ(counts[a].get(c, 0), arrived[a], counts[b].get(c, 0), arrived[b]):
                    return False
            todo += [(children[a][c], children[b][c]) for c in children[a].keys() & children[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            arrived[a] += arrived[b]
            ended[a] += ended[b]
            for c, n in counts[b].items():
                counts[a][c] = counts[a].get(c, 0) + n
            for c, below in children[b].items():
                if c in children[a]:
                    todo.append((children[a][c], below))
                else:
                    children[a][c] = below

    kept = [0]
    while True:
        # of the states next to kept ones, the one most often reached
        edge = max(((arrived[children[k][c]], -k, c) for k in kept for c in children[k] if children[k][c] not in kept), default=None)
        if edge is None:
            break
        parent, c = -edge[1], edge[2]
        blue = children[parent][c]
        for k in kept:
            if compatible(k, blue):
                children[parent][c] = k
                fold(k, blue)
                break
        else:
            kept.append(blue)
    number = {k: i for i, k in enumerate(kept)}
    steps = [{c: (number[children[k][c]], math.log(n / arrived[k])) for c, n in counts[k].items()} for k in kept]
    ends = [math.log(ended[k] / arrived[k]) if ended[k] else _UNSEEN for k in kept]
    return Automaton(steps, ends)


def learn(credentials: dict[str, list[str]], alpha: float = ALPHA) -> dict[str, Automaton]:
    """An automaton for each kind with enough labelled credentials."""
    out = {}
    for kind, values in sorted(credentials.items()):
        values = [symbols(v) for v in sorted(values)]
        if len(values) >= SAMPLE_LEAST:
            automaton = infer(values, alpha)
            costs = np.array([c for v in values for c in automaton.costs(v)[:-1]])
            automaton.mean, automaton.deviation = float(costs.mean()), float(costs.std())
            out[kind] = automaton
    return out


def token_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every run of token bytes; no run crosses rows."""
    inside = _TOKEN_BYTE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


#: So few tokens that are longer than all others are finished one by one.
_FEW = 8


def log_likelihoods(tables: tuple[np.ndarray, np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, give_up: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: the log probability of its symbols, and of stopping there (-inf for both, with ``give_up``, after a step never seen)."""
    following, cost, stop = tables
    dead = len(stop) - 1
    onward, rows = following.tolist(), cost.tolist()
    steps, last = np.full(len(starts), -np.inf), np.full(len(starts), -np.inf)
    left = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running are a prefix
    sizes, state, total = (ends - starts)[left], np.zeros(len(left), np.int64), np.zeros(len(left))
    j = -1
    for j in range(int(sizes[0]) if len(sizes) > _FEW else 0):
        running = int(np.searchsorted(-sizes, -j, side="left"))
        over = slice(running, len(left))
        steps[left[over]], last[left[over]] = total[over], stop[state[over]]
        left, sizes, state, total = left[:running], sizes[:running], state[:running], total[:running]
        symbol = _SYMBOL[data[starts[left] + j]]
        total = total + cost[state, symbol]
        state = following[state, symbol]
        if give_up:
            alive = state != dead
            left, sizes, state, total = left[alive], sizes[alive], state[alive], total[alive]
        if len(left) <= _FEW:
            break
    for k in range(len(left)) if len(left) <= _FEW else ():
        at, rest, p = int(state[k]), _SYMBOL[data[starts[left[k]] + j + 1 : ends[left[k]]]].tolist(), float(total[k])
        for c in rest:
            p += rows[at][c]
            at = onward[at][c]
            if give_up and at == dead:
                p, at = -np.inf, dead
                break
        steps[left[k]], last[left[k]] = p, stop[at] if p > -np.inf else -np.inf
    if len(left) <= _FEW:
        return steps, last
    steps[left], last[left] = total, stop[state]
    return steps, last


class Judge:
    """Scores all tokens by the automata of credentials against that of ordinary tokens."""

    def __init__(self, automata: dict[str, Automaton], ordinary: Automaton | None = None, deviations: float = DEVIATIONS, rarity: float = RARITY, least_bits: float = LEAST_BITS):
        self.kinds = [(a.tables(), a.mean, a.deviation) for a in automata.values()]
        self.ordinary = ordinary.tables() if ordinary else None
        self.deviations, self.least, self.least_bits = deviations, math.log(rarity), least_bits

    def likely(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The highest log likelihood of each token by the automata that find it typical and hard to guess; -inf if none does."""
        out = np.full(len(starts), -np.inf)
        if not len(starts):
            return out
        within = np.concatenate([[0.0], np.cumsum(_WITHIN[_SYMBOL[data]])])
        within = within[ends] - within[starts]
        for tables, mean, deviation in self.kinds:
            steps, stop = log_likelihoods(tables, data, starts, ends, True)
            fits = (np.abs(steps / (ends - starts) - mean) <= self.deviations * deviation / np.sqrt(ends - starts)) & (within - steps / math.log(2) >= self.least_bits)
            out = np.maximum(out, np.where(fits, steps + stop, -np.inf))
        return out

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the tokens that look like credentials."""
        starts, ends = token_bounds(data, offsets)
        likely = self.likely(data, starts, ends)
        fitting = np.flatnonzero(likely > -np.inf)
        starts, ends, likely = starts[fitting], ends[fitting], likely[fitting]
        if self.ordinary is None or not len(starts):
            return starts[:0], ends[:0]
        chosen = likely - np.add(*log_likelihoods(self.ordinary, data, starts, ends, False)) >= self.least
        return starts[chosen], ends[chosen]


def _scanned(column: pa.Array, judge: Judge | None) -> Iterator[tuple[int, int, dict[int, tuple[list, list]]]]:
    """For chunks of rows: first row, last row + 1, and for rows with finds their base spans (with credentials) and the added ones; code points."""
    for lo, hi, data, offsets in text_chunks(column):
        part = column.slice(lo, hi - lo)
        may = np.flatnonzero(pc.match_substring_regex(part, _MAY_HOLD).to_numpy(zero_copy_only=False))
        starts, ends = judge.tokens(data, offsets) if judge else (np.zeros(0, np.int64),) * 2
        of_row = np.searchsorted(offsets, starts, side="right") - 1
        rows = np.union1d(may, of_row).astype(np.int64)
        found: dict[int, tuple[list, list]] = {}
        for i, text in zip(rows.tolist(), part.take(pa.array(rows)).to_pylist()):
            base = base_spans(text)
            a, b = np.searchsorted(of_row, [i, i + 1])
            added = []
            if b > a:
                point = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                for x, y in zip(point[starts[a:b] - offsets[i]].tolist(), point[ends[a:b] - offsets[i]].tolist()):
                    added.append(("format", x, y))
            # base spans of a kind do not overlap: of those that end behind a token's start the first also starts first
            for kind in KINDS[:3] if added else ():
                edges = [(s[1], s[2]) for s in base if s[0] == kind]
                last = [e for _, e in edges]
                added = [t for t in added if (k := bisect.bisect_right(last, t[1])) == len(edges) or edges[k][0] >= t[2]]
            if base or added:
                found[i] = base, added
        yield lo, hi, found


def _order(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


_RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, places array<struct<start:long,end:long>>"


def _judged(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, found in _scanned(pc.fill_null(batch.column("text"), ""), judge):
                out: list[list] = [[0, 0, 0, 0, nothing, "", []] for _ in range(hi - lo)]
                for i, (base, added) in found.items():
                    spans = [s[:3] for s in base]
                    texts = [",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=_order)) for x in (spans, spans + added)]
                    places = [{"start": a, "end": b} for _, a, b in sorted(spans + added, key=_order)]
                    out[i] = [*(sum(s[0] == k for s in spans + added) for k in KINDS), hashlib.sha256(texts[0].encode()).hexdigest(), texts[1], places]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names=[f.split()[0] for f in _RESULT.split(", ")])

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled credentials (kind, value); and, of picked rows, evenly spaced tokens that lie in none, as kind ``ordinary``."""
    for batch in batches:
        column, picked = pc.fill_null(batch.column("text"), ""), batch.column("picked")
        for lo, hi, found in _scanned(column, None):
            kinds, values = [], []
            for base, _ in found.values():
                kinds += [s[0] for s in base]
                values += [s[3] for s in base]
            for i in range(lo, hi):
                if picked[i].as_py():
                    data = np.frombuffer(column[i].as_py().encode(), np.uint8)
                    starts, ends = token_bounds(data, np.array([0, len(data)]))
                    every = np.unique(np.linspace(0, max(0, len(starts) - 1), ORDINARY_TOKENS).astype(np.int64)) if len(starts) else []
                    labelled = {s[3] for s in found.get(i - lo, ([], []))[0]}
                    for t in (data[starts[j] : ends[j]].tobytes().decode() for j in every):
                        if not any(t in x or x in t for x in labelled):
                            kinds.append("ordinary")
                            values.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])


def labelled_sample(docs: DataFrame, sample: int = SAMPLE, ordinary_docs: int = ORDINARY_DOCS) -> dict[str, list[str]]:
    """About ``sample`` distinct credentials of each kind, by their hash, and ordinary tokens of about ``ordinary_docs`` documents; the bounds hold for any input."""
    share = min(1.0, ordinary_docs / max(1, docs.count()))
    picked = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < F.lit(share * 1_000_000)
    # copies of a picked text count once
    found = stored(docs.select("text", F.coalesce(picked, F.lit(False)).alias("picked")).mapInArrow(_labels, "kind string, value string"), "labels")
    values = stored(found.groupBy("kind", "value").agg(F.count("*").alias("times")), "values")
    totals = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in totals.items():
        share = F.when(F.col("kind") == kind, F.lit(min(1.0, (ordinary_docs * ORDINARY_TOKENS if kind == "ordinary" else sample) / n))).otherwise(share)
    out: dict[str, list[str]] = {}
    for r in values.filter(F.pmod(F.xxhash64("value", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).collect():
        # an ordinary token counts as often as it stands, up to a bound; a credential once
        out.setdefault(r["kind"], []).extend([r["value"]] * (min(r["times"], ORDINARY_DOCS) if r["kind"] == "ordinary" else 1))
    return out


def judge_of(docs: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA, deviations: float = DEVIATIONS, rarity: float = RARITY) -> Judge:
    """The automata learnt from ``docs``; with fewer than SAMPLE_LEAST labelled credentials of a kind it teaches nothing."""
    found = labelled_sample(docs, sample)
    ordinary = sorted(found.pop("ordinary", []))
    automata = learn(found, alpha)
    # a token that a credential's automaton would write may be one itself, and teaches nothing about ordinary ones
    data = np.frombuffer(" ".join(ordinary).encode(), np.uint8)
    starts, ends = token_bounds(data, np.array([0, len(data)]))
    free = Judge(automata, None, deviations, rarity).likely(data, starts, ends) == -np.inf
    plain = [symbols(data[a:b].tobytes().decode()) for a, b in zip(starts[free], ends[free])]
    return Judge(automata, infer(plain, alpha) if plain else None, deviations, rarity)


def find_secrets(docs: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA, deviations: float = DEVIATIONS, rarity: float = RARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans, places.

    ``base_sha256`` digests the base spans as kind:start:end by start, then
    kind; ``spans`` lists them with those of kind ``format`` that the automata
    add, which overlap no base span; ``places`` has the same as (start, end).
    Offsets are code points, end exclusive.  Null and empty text have none.
    Spans that tie in start go by kind, then end.  Repeated rows repeat; other
    columns play no part.  No rows in: no rows out.
    """
    judge = judge_of(docs, sample, alpha, deviations, rarity)
    return docs.select("doc_id", "text").mapInArrow(_judged(judge), _RESULT)


def redacted(docs: DataFrame, mark: str = "<SECRET>", sample: int = SAMPLE, alpha: float = ALPHA, deviations: float = DEVIATIONS, rarity: float = RARITY) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and n_chars, if there, counted anew; columns and rows stay."""
    judge = judge_of(docs, sample, alpha, deviations, rarity)

    def clean(text: str, spans: list[tuple]) -> str:
        out, at = [], 0
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if b > at:
                out += [text[at : max(a, at)], mark] if a >= at else []
                at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.schema.names, batch.column("text")
            cleaned: dict[int, str] = {}
            for lo, _, found in _scanned(pc.fill_null(texts, ""), judge):
                for i, (base, added) in found.items():
                    cleaned[lo + i] = clean(texts[lo + i].as_py(), [s[:3] for s in base] + added)
            if cleaned:
                mask = np.zeros(batch.num_rows, bool)
                mask[sorted(cleaned)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([cleaned[i] for i in sorted(cleaned)], texts.type))
                batch = batch.set_column(names.index("text"), "text", texts)
                if "n_chars" in names:
                    sizes = pc.cast(pc.utf8_length(texts), batch.schema.field("n_chars").type)
                    batch = batch.set_column(names.index("n_chars"), "n_chars", pc.if_else(pa.array(mask), sizes, batch.column("n_chars")))
            yield batch

    return docs.mapInArrow(run, docs.schema)
