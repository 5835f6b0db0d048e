"""Pairs of alike texts inside groups, found by exact bounds on the letters they share."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import LONG_TEXT, most_similarity
from .graphs import stored

#: Texts of a group that are paired as they are; the letters of more are looked at first.
SMALL_GROUP = 64


def _runs(keys: Sequence[str], q: int):
    """Each text's different runs of ``q`` letters (of all, if fewer) and how often each occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *own, text in zip(*(batch[k] for k in keys), batch["text"]):
                times = Counter(text[i : i + q] for i in range(max(len(text) - q + 1, 1)))
                yield pd.DataFrame({**{k: [v] * len(times) for k, v in zip(keys, own)}, "n": len(text), "run": list(times), "times": list(times.values())})

    return run


def met_by_letters(texts: DataFrame, within: Sequence[str], key: str, percent: int) -> DataFrame:
    """within, a, b (a < b): pairs of ``key`` whose texts' likeness (2 * matched / both lengths) may be ``percent`` or more; loses none that is.

    ``texts`` has the group columns ``within``, ``key``, ``text`` and may have
    ``n``, its letters; equal texts of a group should be one key.  The texts of a
    group of SMALL_GROUP or fewer meet where their lengths allow it, which makes
    fewer rows than their letters.  In a larger one, with lengths of sum t and p the share, p * t /
    2 letters match, in at most (1 - p) * t + 1 blocks, so of runs of q letters
    at least p * t / 2 - (q - 1) * ((1 - p) * t + 1) are shared, and the shorter
    text is p / (2 - p) of the longer.  Two texts that share so many have one in
    common among all but that many of their own, rarest first.  Only those
    meet, on group and run, so that a large group is spread over its runs.

    The tables of runs are merged, never broadcast: their files are many times
    smaller than their rows, so Spark's estimate of them is too.
    """
    p = percent / 100
    q = 2 if percent >= 82 else 1
    n = F.col("n") if "n" in texts.columns else F.length("text")
    lengths_allow = F.least("n_a", "n_b") * (2 - p) >= F.greatest("n_a", "n_b") * p - 1e-9
    sides = lambda rows, *more: [rows.select(*within, *more, F.col(key).alias(side), F.col("n").alias(f"n_{side}")) for side in ("a", "b")]
    # a text alone in its group meets none
    sizes = stored(texts.filter(n > 0).groupBy(*within).agg(F.count("*").alias("_texts")).filter("_texts > 1"), "groups")
    few = texts.filter(n > 0).select(*within, key, n.alias("n")).join(sizes.filter(F.col("_texts") <= SMALL_GROUP).hint("merge"), list(within))
    left, right = sides(few)
    paired = left.join(right.hint("merge"), list(within)).filter("a < b").filter(lengths_allow).select(*within, "a", "b").distinct()
    many = sizes.filter(F.col("_texts") > SMALL_GROUP).drop("_texts")
    if many.isEmpty():
        return paired
    # dealt out by number, which is never coalesced, as few texts make many runs
    spread = texts.filter(n > 0).join(many, list(within)).select(*within, key, "text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *within, key)
    own = [spread.schema[c] for c in (*within, key)]
    dealt = stored(spread.mapInPandas(_runs([*within, key], q), StructType([*own, StructField("n", IntegerType()), StructField("run", StringType()), StructField("times", LongType())])), "runs")
    held = dealt.groupBy(*within, "run").agg(F.sum("times").alias("held"))
    shared = F.greatest(F.lit(1), F.ceil((p / 2 - (q - 1) * (1 - p)) * 2 * F.col("n") / (2 - p) - (q - 1) - 1e-9))
    before = F.coalesce(F.sum("times").over(Window.partitionBy(*within, key).orderBy("held", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.col("n") - q + 1, F.lit(1)) - shared + 1 - before
    kept = dealt.join(held.hint("merge"), [*within, "run"]).withColumn("room", room).filter("room > 0").select(*within, key, "n", "run", F.explode(F.sequence(F.lit(1), F.least("times", "room").cast("int"))).alias("nth"))
    kept = stored(kept, "kept")
    left, right = sides(kept, "run", "nth")
    met = left.join(right.hint("merge"), [*within, "run", "nth"]).filter("a < b")
    return paired.unionAll(met.filter(lengths_allow).select(*within, "a", "b").distinct())


def likenesses(pairs: DataFrame, texts: DataFrame, within: Sequence[str], key: str, likeness: Callable[[Column, Column], Column]) -> DataFrame:
    """``pairs`` (within, a, b, percent and more) with sim: the likeness with a's text left, of those that have ``percent``.

    Likeness being 2 * matched / both lengths with matches in order, a pair
    whose common subsequence is too short is dropped before it is measured,
    unless its right text is one of LONG_TEXT, which is measured as fast.  Pairs
    are dealt out by number: rows are few, and measuring them is the work.
    """
    side = lambda name: texts.select(*within, F.col(key).alias(name), F.col("text").alias(f"text_{name}"))
    parts = 8 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(side("a"), [*within, "a"]).join(side("b"), [*within, "b"]).repartition(parts, *within, "a", "b")
    long = F.length("text_b") >= LONG_TEXT
    most = most_similarity(F.when(~long, F.col("text_a")), F.when(~long, F.col("text_b")))
    able = both.withColumn("_most", most).filter(long | (F.col("_most") >= F.col("percent") / 100 - 1e-9))
    return able.withColumn("sim", likeness(F.col("text_a"), F.col("text_b"))).filter(F.col("sim") >= F.col("percent") / 100).drop("_most", "text_a", "text_b", "percent")
