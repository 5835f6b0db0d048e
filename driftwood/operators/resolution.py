"""Resolving names to master data, and checking results against ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import stored

#: Scores from which a suggestion is of medium or low confidence; an equal key is high.
MEDIUM, LOW = 0.72, 0.45


def resolved(asked: DataFrame, id_: str, attempts: str, places: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """id, place: the place of the first attempt (array, in order of trust) whose key is that of exactly one place; null if none.

    ``places`` has place, alias.  An alias of several places resolves nothing.
    """
    known = places.select(key(F.col("alias")).alias("_key"), "place").groupBy("_key").agg(F.min("place").alias("place"), F.max("place").alias("_other")).filter("place = _other").drop("_other")
    tried = asked.select(id_, F.posexplode(attempts).alias("_at", "_text")).select(id_, "_at", key(F.col("_text")).alias("_key"))
    hits = tried.join(known, "_key").groupBy(id_).agg(F.min_by("place", "_at").alias("place"))
    return asked.select(id_).join(hits, id_, "left")


def suggestions(asked: DataFrame, id_: str, text: str, places: DataFrame, key: Callable[[Column], Column], likeness: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """id, place, score, confidence: up to ``most`` places of like names, HIGH for an equal key, MEDIUM from 0.72, LOW from 0.45.

    Distinct texts are compared, each with the places that share a pair of
    letters with it, so neither copies nor strangers are.
    """
    pairs_of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    names = places.select("place", key(F.col("alias")).alias("_name")).filter("_name <> ''")
    texts = asked.select(key(F.col(text)).alias("_text")).filter("_text <> ''").distinct()
    met = texts.withColumn("_pair", F.explode(pairs_of(F.col("_text")))).join(names.withColumn("_pair", F.explode(pairs_of(F.col("_name")))), "_pair")
    scored = met.select("_text", "place", "_name").distinct().withColumn("score", likeness(F.col("_text"), F.col("_name")))
    best = scored.groupBy("_text", "place").agg(F.max("score").alias("score")).filter(F.col("score") >= LOW)
    rank = F.row_number().over(Window.partitionBy("_text").orderBy(F.desc("score"), "place"))
    top = best.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    confidence = F.when(F.col("score") == 1.0, "HIGH").when(F.col("score") >= MEDIUM, "MEDIUM").otherwise("LOW")
    return asked.select(id_, key(F.col(text)).alias("_text")).join(top, "_text").select(id_, "place", F.round("score", 4).alias("score"), confidence.alias("confidence"))


def unique_or_null(matches: Column) -> Column:
    """The only distinct element of an array; null if there are none or several."""
    found = F.array_distinct(matches)
    return F.when(F.size(found) == 1, found[0])


def reconciled(truth: DataFrame, found: DataFrame, key: str, most: int) -> DataFrame:
    """kind, key: ground truth nothing was found for, findings without ground truth, and truths found more than ``most`` times."""
    missed = truth.join(found, key, "left_anti").select(F.lit("missed").alias("kind"), key)
    stray = found.select(key).distinct().join(truth, key, "left_anti").select(F.lit("unmatched").alias("kind"), key)
    repeated = found.join(truth, key, "left_semi").groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit("repeated").alias("kind"), key)
    return missed.unionAll(stray).unionAll(repeated)


#: Likeness from which two unresolved names are one place.
ALIKE = 0.82


def alike_names(names: DataFrame, likeness: Callable[[Column, Column], Column], percent: int = int(ALIKE * 100)) -> DataFrame:
    """a, b of all distinct non-empty ``name`` whose likeness (2 * matched / both lengths) is ``percent`` or more, both ways.

    With lengths of sum t, matched letters are at least t * p / 2 and lie in at
    most t * (1 - p) + 1 blocks, so t * (1.5 * p - 1) - 1 letter pairs are
    shared, and the shorter is p / (2 - p) of the longer.  Two names that share
    so many have one in common among all but that many of their pairs, rarest
    first; only those meet.
    """
    p = percent / 100
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))), lambda i: F.substr("name", i, F.lit(2)))
    dealt = names.select("name", F.explode(pairs).alias("pair"))
    dealt = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("name", "pair").orderBy("pair")))
    held = dealt.groupBy("pair", "nth").agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("held", "pair", "nth"))
    n = F.length("name")
    shared = F.greatest(F.lit(1), F.ceil(n * (1 + p / (2 - p)) * (1.5 * p - 1) - 1 - 1e-9))
    rare = dealt.join(held, ["pair", "nth"]).withColumn("rank", rank).filter(F.col("rank") <= F.greatest(n - 1, F.lit(1)) - shared + 1).select("name", "pair", "nth")
    met = rare.select(F.col("name").alias("a"), "pair", "nth").join(rare.select(F.col("name").alias("b"), "pair", "nth"), ["pair", "nth"])
    shorter, longer = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    met = met.filter((F.col("a") != F.col("b")) & (shorter * (2 - p) >= longer * p - 1e-9)).select("a", "b").distinct()
    # the measure depends on the side; the earlier name stands left, as a seed does
    met = met.filter("a < b").filter(likeness(F.col("a"), F.col("b")) >= p)
    return met.unionAll(met.select(F.col("b").alias("a"), F.col("a").alias("b")))


def unresolved_clusters(names: DataFrame, links: DataFrame) -> DataFrame:
    """name, seed: in order of ``name``, each that no seed has taken is a seed and takes all linked to it or of its place.

    ``names`` has name, place (null: none); ``links`` a, b, both ways.  A name is
    decided once the least earlier one linked to it, of those that no seed has
    taken, is a seed or there is none.
    """
    open_ = stored(names.select("name", "place"))
    links = stored(links)
    seeds = open_.limit(0).select("name", "place")
    done = None
    while not open_.isEmpty():
        alive = stored(open_.select("name", "place", F.lit(False).alias("seed")).unionAll(seeds.select("name", "place", F.lit(True).alias("seed"))))
        of_place = alive.filter("place is not null").groupBy("place").agg(F.min(F.struct("name", "seed")).alias("first"))
        near = links.join(alive.select(F.col("name").alias("b"), "seed"), "b").filter("b < a").groupBy(F.col("a").alias("name")).agg(F.min(F.struct(F.col("b").alias("name"), "seed")).alias("linked"))
        state = open_.join(near, "name", "left").join(of_place, "place", "left")
        first = F.least(F.col("linked"), F.when(F.col("first.name") < F.col("name"), F.col("first")))
        state = stored(state.select("name", "place", first.alias("to")))
        new = state.filter("to is null").select("name", "place")
        taken = state.filter("to.seed").select("name", F.col("to.name").alias("seed"))
        told = taken.unionAll(new.select("name", F.col("name").alias("seed")))
        done = told if done is None else done.unionAll(told)
        seeds = seeds.unionAll(new)
        open_ = state.filter("to is not null and not to.seed").select("name", "place")
    return names.select("name", F.col("name").alias("seed")).limit(0) if done is None else done


def clustered(texts: DataFrame, places: DataFrame, key: Callable[[Column], Column], likeness: Callable[[Column, Column], Column]) -> DataFrame:
    """text, seed (keys) of distinct unresolved ``text``: of one suggested place from MEDIUM, or alike from 0.82; brackets aside."""
    core = F.trim(F.regexp_replace("text", r"[(\[（].*$", ""))
    texts = texts.select("text", F.when(core != "", core).otherwise(F.col("text")).alias("core"))
    texts = stored(texts.withColumn("name", key(F.col("core"))).filter("name <> ''"))
    names = stored(texts.select("name").distinct())
    same = lambda c: c
    found = suggestions(names, "name", "name", places.select("place", key(F.col("alias")).alias("alias")), same, likeness, 1).filter("confidence <> 'LOW'")
    seeds = unresolved_clusters(names.join(found.select("name", "place"), "name", "left"), alike_names(names, likeness))
    return texts.join(seeds, "name").select("text", "seed")
