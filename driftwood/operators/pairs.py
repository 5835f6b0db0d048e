"""The life of a pair of events that may be one: evidence, readiness, status, order, release, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say what kind of night it is, and so name none.
GENERIC = ("milonga", "social", "party", "night", "tango", "salsa", "밀롱가", "소셜", "파티")
#: Minutes within which two sources' starts count as one.
CLOSE_MINUTES = 60
#: What may be said for a pair.
FACTS = ("NAME", "START", "PLACE", "INDEPENDENT")


def name_words(name: Column, generic: Sequence[str] = GENERIC) -> Column:
    """The distinctive words of a name."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.filter(words, lambda w: ~w.isin(*generic))


def names_match(a: Column, b: Column) -> Column:
    """Whether two names (as ``name_words``) name one night: all words of one in the other, or one run together inside the other.

    A name without distinctive words names no night.
    """
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    one, two = F.array_join(a, ""), F.array_join(b, "")
    within = lambda short, words, long: F.contains(long, short) & F.forall(words, lambda w: F.contains(long, w))
    together = F.when(F.length(one) <= F.length(two), within(one, a, two)).otherwise(within(two, b, one))
    return (F.size(a) > 0) & (F.size(b) > 0) & (inside(a, b) | inside(b, a) | together)


def half_day_apart(a: Column, b: Column) -> Column:
    """One clock read twice."""
    return F.abs(a - b) == 720


def met(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b (structs of the other columns), names of every two members (event_id, words, ...) that share the keys, the smaller id first.

    Names are compared once for two names of a group, however many members bear
    them: a member brings the numbers of the names that match its own, the first
    64 as bits, and a pair looks one number up.  Members meet as flat columns, of
    which a pair makes only those that are read, and are dealt out by number: few
    rows make many pairs.
    """
    numbered = members.dropna(subset=list(keys)).withColumn("name", F.dense_rank().over(Window.partitionBy(*keys).orderBy("words")))
    borne = numbered.select(*keys, "name", "words").distinct()
    other = borne.select(*keys, F.col("name").alias("_name"), F.col("words").alias("_words"))
    bit = F.when(F.col("_name") <= 64, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_name") - 1))
    alike = borne.join(other, list(keys)).filter(names_match(F.col("words"), F.col("_words"))).groupBy(*keys, "name").agg(F.bit_or(bit).alias("alike"), F.collect_list(F.when(F.col("_name") > 64, F.col("_name"))).alias("alike_more"))
    rows = numbered.drop("words").join(alike, [*keys, "name"], "left").repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    own = [c for c in rows.columns if c not in keys]
    side = lambda n: rows.select(*keys, *[F.col(c).alias(f"_{n}_{c}") for c in own])
    joined = side("a").join(side("b"), list(keys)).filter("_a_event_id < _b_event_id")
    one_of_64 = F.call_function("shiftright", F.col("_a_alike"), F.col("_b_name") - 1).bitwiseAND(F.lit(1)) == 1
    names = F.when(F.col("_b_name") <= 64, one_of_64).otherwise(F.array_contains("_a_alike_more", F.col("_b_name")))
    told = [c for c in own if c not in ("alike", "alike_more")]
    return joined.select(*keys, *[F.struct(*[F.col(f"_{n}_{c}").alias(c) for c in told]).alias(n) for n in ("a", "b")], F.coalesce(names, F.lit(False)).alias("names"))


def readiness(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ready, strength and facts: what says that two events (structs a and b) are one.

    The structs have words (unless ``pairs`` has names: whether they match),
    start_min, venue_id, source_id, end_date, festival.  A field that nobody
    stated is no evidence; two resolved venues that differ always refuse.
    """
    a, b = F.col("a"), F.col("b")
    known = lambda f: a.getField(f).isNotNull() & b.getField(f).isNotNull()
    same = lambda f: F.coalesce(a.getField(f) == b.getField(f), F.lit(False))
    names = F.col("names") if "names" in pairs.columns else names_match(a.words, b.words)
    said = {
        "NAME": names, "START": same("start_min"), "PLACE": same("venue_id"), "INDEPENDENT": known("source_id") & ~same("source_id"), "PLACES_DIFFER": known("venue_id") & ~same("venue_id"),
        "CLOSE": ~known("start_min") | (F.abs(a.start_min - b.start_min) <= CLOSE_MINUTES), "FESTIVALS": a.festival & b.festival & ~(known("end_date") & ~same("end_date")),
    }
    # what is said is one number, made once for a pair, and what follows from it is looked up
    number = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(said.values())), F.lit(0))
    cases = [{f for k, f in enumerate(said) if n >> k & 1} for n in range(1 << len(said))]
    whys = [_why(case) for case in cases]
    strengths = [("STRONG" if "INDEPENDENT" in c or {"NAME", "START", "PLACE"} <= c else "MODERATE") if w else "WEAK" if c & {"NAME", "START", "PLACE"} else "NONE" for c, w in zip(cases, whys)]
    columns = {
        "ready": [w is not None for w in whys], "why": whys, "strength": strengths, "facts": [",".join(f for f in FACTS if f in c) for c in cases],
        "auto": [w == "RULES" for w in whys], "paired": [not c.isdisjoint(("NAME", "START")) for c in cases],
    }
    return pairs.withColumn("_said", number).withColumns({c: F.get(F.array(*map(F.lit, told)), F.col("_said")) for c, told in columns.items()}).drop("_said")


def _why(said: set[str]) -> str | None:
    """The rule by which a pair is one, of what is said for it; none: None."""
    if {"PLACE", "START"} <= said:
        return "RULES"
    if "PLACES_DIFFER" in said:
        return None
    if {"NAME", "START"} <= said:
        return "NAME_AND_START"
    if {"FESTIVALS", "NAME", "INDEPENDENT"} <= said:
        return "FESTIVAL_OF_TWO_SOURCES"
    return "NAME_AND_PLACE_OF_TWO_SOURCES" if {"NAME", "PLACE", "INDEPENDENT", "CLOSE"} <= said else None


def pair_status(pairs: DataFrame) -> DataFrame:
    """``pairs`` with status, by precedence: a person decided, a member is gone, a member was folded since, the rules fold it, no rule pairs it, open, or blocked.

    Reads decided_by, missing, a_root and b_root (canonical ids, null for
    none), person_fold, rule (null: none), auto, open.
    """
    folded = F.col("a_root").isNotNull() | F.col("b_root").isNotNull()
    joined = F.coalesce("a_root", "a_id") == F.coalesce("b_root", "b_id")
    status = (
        F.when(F.col("decided_by") == "PERSON", "PERSON")
        .when(F.col("missing"), "INVALID")
        .when(folded & joined & ~F.col("person_fold"), "RULES")
        .when(folded, "SUPERSEDED")
        .when(F.col("rule").isNull() | F.col("auto"), "STALE")
        .when(F.col("open"), "ACTIONABLE")
        .otherwise("BLOCKED")
    )
    return pairs.withColumn("status", status)


def queue_priority(status: Column, timing: Column) -> Column:
    """Where a pair stands in the queue: what can still be attended first."""
    open_ = F.when(timing == "ONGOING", 0).when(timing == "UPCOMING", 1).when(timing == "UNKNOWN", 2).otherwise(4)
    return F.when(status == "ACTIONABLE", open_).when(status.isin("STALE", "BLOCKED"), F.when(timing == "PAST", 5).otherwise(3)).otherwise(6)


def stale_folds(events: DataFrame, still: Column) -> DataFrame:
    """event_id, canonical_id, listing of automatic folds that the rules would not make now.

    ``events`` has event_id, canonical_id, decided_by, review; ``still`` judges
    a (the fold) and b (its canonical event), structs of the event's columns.
    A person's fold is never asked again, nor one whose canonical event is not
    there.
    """
    of = lambda name: F.struct(*[F.col(c) for c in events.columns]).alias(name)
    folds = events.filter("canonical_id is not null and not decided_by <=> 'PERSON'").select(of("a"))
    roots = events.select(of("b"))
    asked = folds.join(roots, F.col("a.canonical_id") == F.col("b.event_id")).filter(~F.coalesce(still, F.lit(False)))
    listing = F.when(F.upper("a.review").isin("REJECTED", "DUPLICATE"), "HIDDEN").otherwise("LISTED")
    return asked.select("a.event_id", "a.canonical_id", listing.alias("listing"))


def integrity(events: DataFrame) -> DataFrame:
    """gate, n: counts that must be zero of events (event_id, canonical_id, listing): folds of themselves, of events that are gone, of folded ones, and folded but listed."""
    roots = events.select(F.col("event_id").alias("root"), F.col("canonical_id").alias("above"))
    joined = events.join(roots, F.col("canonical_id") == F.col("root"), "left")
    fold = F.col("canonical_id").isNotNull()
    gates = {"SELF_FOLD": F.col("canonical_id") == F.col("event_id"), "ROOT_GONE": fold & F.col("root").isNull(), "CHAINED": fold & F.col("above").isNotNull(), "FOLDED_BUT_LISTED": fold & (F.col("listing") == "LISTED")}
    counted = joined.agg(*[F.count_if(c).alias(g) for g, c in gates.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("n")) for g in gates])).alias("x")).select("x.gate", "x.n")
