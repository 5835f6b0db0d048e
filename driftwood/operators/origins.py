"""Where posts about one event come from: cross-posts, their likely origin, and which sources are independent.

Posts carry event, source, post_id, title, body, published_at, url, poster and
origin (the source a post itself names; null: none).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, host
from .duplicates import greedy_clique
from .graphs import components, stored
from .likeness import likenesses, met_by_letters

#: Percent of likeness from which texts are one, and from which they are if their posters are.
ALIKE, ALIKE_WITH_POSTER = 86, 65
#: What a person's decision makes of a suspected cluster.
DECISIONS = {"CONFIRM_SYNDICATION": "CONFIRMED_SYNDICATION", "CONFIRM_INDEPENDENT": "CONFIRMED_INDEPENDENT", "HOLD": "AUTO_SUSPECTED_SYNDICATION"}


def _letters(text: Column) -> Column:
    # one class of all three ranges takes Java four times as long
    return F.trim(F.regexp_replace(F.lower(text), "(?:[^0-9a-z](?<![가-힣]))+", " "))


def compared_text(title: Column, body: Column) -> Column:
    """Lower-case letters and digits of title and body, parted by single blanks; addresses stay, as words."""
    full = F.array_join(F.filter(F.array(title, body), lambda t: F.coalesce(t, F.lit("")) != ""), " ")
    return _letters(full)


def content_digest(title: Column, body: Column) -> Column:
    """Digest of the text without addresses; null if nothing is left."""
    full = F.array_join(F.filter(F.array(title, body), lambda t: F.coalesce(t, F.lit("")) != ""), " ")
    bare = _letters(F.regexp_replace(F.lower(full), r"https?://\S+", " "))
    return F.when(bare != "", F.sha2(bare, 256))


def latest_posts(posts: DataFrame) -> DataFrame:
    """A source's latest post on each event, with ``turn``: the place its first post gives the source among the event's."""
    per = posts.groupBy("event", "source").agg(F.max_by(F.struct("title", "body", "published_at", "url", "poster", "origin"), "post_id").alias("last"), F.max("post_id").alias("post_id"), F.min("post_id").alias("turn"))
    return per.select("event", "source", "post_id", "turn", "last.*")


def cross_posts(posts: DataFrame, likeness: Callable[[Column, Column], Column], alike: int = ALIKE, with_poster: int = ALIKE_WITH_POSTER) -> DataFrame:
    """Members of suspected cross-post clusters: event, cluster, source, published_at, text_similarity, same_poster, same_host, origin_score, is_origin, member_count, signals.

    Two sources of an event are linked if their latest texts are alike by
    ``alike`` percent, or by ``with_poster`` with one poster; links chain.  A
    cluster is named after its least source.  The earliest publication is the
    likely origin (unknown times last, ties by source).  A member's similarity
    is the best over its links, and its signals are theirs.  Texts are measured
    with the source that came to the event first on the left.  Posts without
    letters are alike to none.

    Equal texts of an event are one class, and only classes meet: copies are
    never paired, whatever their number.
    """
    latest = latest_posts(posts).withColumn("text", compared_text(F.col("title"), F.col("body")))
    # filtered when it is read: a filter before would make the text twice
    latest = stored(latest.select("event", "source", "turn", "published_at", host(F.col("url")).alias("host"), "poster", "text", F.sha2("text", 256).alias("digest")), "posts").filter("text <> ''")
    grouped = latest.groupBy("event", "digest").agg(F.min("text").alias("text"), F.length(F.min("text")).alias("n"), F.count("*").alias("copies"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = stored(latest.drop("text").join(classes.select("event", "digest", "class", "copies", "first", "last"), ["event", "digest"]).drop("digest"), "members")

    # texts alike by themselves, and texts alike that some sources show under one poster
    near = met_by_letters(classes.select("event", "class", "text", "n"), ["event"], "class", alike)
    shown = members.filter("poster is not null").select("event", "poster", "class").distinct().join(classes.select("class", "text", "n"), "class")
    under = met_by_letters(shown, ["event", "poster"], "class", with_poster).select("event", "a", "b")
    met = near.withColumn("percent", F.lit(alike)).unionAll(under.withColumn("percent", F.lit(with_poster))).groupBy("event", "a", "b").agg(F.min("percent").alias("percent"))
    # one row for each side that stands left for some of its sources
    ends = classes.select("class", "first", "last", "copies")
    sides = stored(met.join(ends.select(F.col("class").alias("a"), F.col("first").alias("first_a"), F.col("last").alias("last_a")), "a").join(ends.select(F.col("class").alias("b"), F.col("first").alias("first_b"), F.col("last").alias("last_b")), "b"), "met")
    ab = sides.filter("first_a < last_b").select("event", "a", "b", "percent", F.col("first_a").alias("first_left"), F.col("last_b").alias("last_right"))
    ba = sides.filter("first_b < last_a").select("event", F.col("b").alias("a"), F.col("a").alias("b"), "percent", F.col("first_b").alias("first_left"), F.col("last_a").alias("last_right"))
    measured = stored(likenesses(ab.unionAll(ba), classes, ["event"], "class", likeness), "likenesses")
    directed = measured.withColumnsRenamed({"a": "left", "b": "right"}).filter(F.col("sim") >= with_poster / 100)
    # from a class's own point of view: to whom it is alike, and which of its sources have a partner there on the right side
    seen = directed.select(F.col("left").alias("class"), F.col("right").alias("other"), "sim", F.lit(None).cast("long").alias("after"), F.col("last_right").alias("before"))
    seen = seen.unionAll(directed.select(F.col("right").alias("class"), F.col("left").alias("other"), "sim", F.col("first_left").alias("after"), F.lit(None).cast("long").alias("before")))
    copies = ends.filter("copies > 1").select("class", F.col("class").alias("other"), F.lit(1.0).alias("sim"), F.lit(None).cast("long").alias("after"), F.lit(None).cast("long").alias("before"))
    seen = stored(seen.unionAll(copies), "seen")

    # what a class shows under a poster or a host, and to how many sources' credit
    shows = lambda *by: members.filter(" and ".join(f"{c} is not null" for c in by)).groupBy(F.col("class").alias("other"), *by).agg(F.count("*").alias("sources"))
    own = members.select("event", "source", "turn", "class", "poster", "host").join(seen, "class").filter("(after is null or after < turn) and (before is null or before > turn)")
    own = own.join(shows("poster"), ["other", "poster"], "left").withColumn("by_poster", F.coalesce(F.col("sources") > (F.col("other") == F.col("class")).cast("int"), F.lit(False))).drop("sources")
    own = own.filter((F.col("sim") >= alike / 100) | F.col("by_poster"))
    # a host counts over the whole other class, or over those under the same poster if only that links them
    own = own.join(shows("host"), ["other", "host"], "left").withColumnRenamed("sources", "any_host").join(shows("host", "poster"), ["other", "host", "poster"], "left")
    same_class = (F.col("other") == F.col("class")).cast("int")
    by_host = F.coalesce(F.when(F.col("sim") >= alike / 100, F.col("any_host") > same_class).otherwise(F.col("sources") > 0), F.lit(False))
    links = own.withColumn("by_host", by_host).groupBy("event", "source").agg(F.max("sim").alias("text_similarity"), F.max("by_poster").alias("same_poster"), F.max("by_host").alias("same_host"), F.max(F.col("sim") >= alike / 100).alias("near"))
    links = stored(links, "links")

    joined = own.filter("other <> class").select(F.col("class").alias("a"), F.col("other").alias("b")).distinct()
    roots = components(joined, "cross-posts")
    linked = links.join(members.select("event", "source", "class", "published_at"), ["event", "source"]).join(roots.withColumnRenamed("node", "class"), "class", "left")
    linked = stored(linked.withColumn("root", F.coalesce("root", "class")), "linked")
    order = F.struct(F.col("published_at").isNull().alias("unknown"), "published_at", "source")
    clusters = linked.groupBy("root").agg(F.min(order)["source"].alias("origin"), F.min("source").alias("cluster"), F.count("*").alias("member_count"))
    full = linked.join(clusters, "root")
    is_origin = F.col("source") == F.col("origin")
    score = F.when(is_origin, 1.0).otherwise(0.5) + F.col("text_similarity") / 10
    signals = F.array_compact(F.array(F.when(F.col("near"), "NEAR_DUPLICATE_TEXT"), F.when(F.col("same_host"), "SAME_LINK_HOST"), F.when(F.col("same_poster"), "SAME_POSTER_URL")))
    return full.select("event", "cluster", "source", "published_at", "text_similarity", "same_poster", "same_host", score.alias("origin_score"), is_origin.alias("is_origin"), "member_count", F.array_join(signals, ",").alias("signals"))


def with_status(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """``members`` with status: suspected, or what the last review (event, cluster, decision, reviewed_at) made of the cluster."""
    last = reviews.groupBy("event", "cluster").agg(F.max_by("decision", "reviewed_at").alias("decision"))
    status = F.coalesce(*[F.when(F.col("decision") == d, s) for d, s in DECISIONS.items()], F.lit(DECISIONS["HOLD"]))
    return members.join(last, ["event", "cluster"], "left").withColumn("status", status).drop("decision")


def stated_pairs(posts: DataFrame, relationships: DataFrame, members: DataFrame) -> DataFrame:
    """event, a, b (a < b) of the pairs that can be independent: sources with a stated relationship, and clusters a person found independent.

    All other pairs of an event are related, syndicated or unknown.
    """
    there = posts.select("event", "source").distinct()
    stated = relationships.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = there.select("event", F.col("source").alias("a")).join(stated, "a").join(there.select("event", F.col("source").alias("b")), ["event", "b"]).select("event", "a", "b")
    told = members.filter(F.col("status") == DECISIONS["CONFIRM_INDEPENDENT"]).select("event", "cluster", "source")
    inside = told.select("event", "cluster", F.col("source").alias("a")).join(told.select("event", "cluster", F.col("source").alias("b")), ["event", "cluster"]).filter("a < b").select("event", "a", "b")
    return pairs.unionAll(inside).distinct()


def pair_verdicts(asked: DataFrame, posts: DataFrame, relationships: DataFrame, members: DataFrame) -> DataFrame:
    """event, a, b, relationship, independence, signals for ``asked`` (event, a, b).

    ``members`` are cross-post members with status, ``relationships`` stated
    ones (a, b, relationship, at; the last one of a pair counts, either way
    round).  A person's word on a cluster decides, then a suspected cluster, then hard
    evidence of one origin, then the stated relationship, then a shared poster;
    platforms that differ prove nothing.  A source never corroborates itself.
    """
    asked = stored(asked, "asked")
    # only sources that are asked for are marked, and their texts are read once
    there = asked.select("event", F.col("a").alias("source")).unionAll(asked.select("event", F.col("b").alias("source"))).distinct()
    latest = latest_posts(posts.join(there, ["event", "source"], "left_semi")).select("event", "source", "origin", content_digest(F.col("title"), F.col("body")).alias("content"), canonical_url(F.col("poster")).alias("poster"), canonical_url(F.col("url")).alias("url"))
    in_cluster = members.select("event", "source", "cluster", "status")
    marks = stored(latest.join(in_cluster, ["event", "source"], "left").select("event", "source", F.struct("origin", "content", "poster", "url", "cluster", "status").alias("mark")), "marks")
    stated = relationships.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max_by("relationship", "at").alias("stated"))
    both = asked.join(marks.select("event", F.col("source").alias("a"), F.col("mark").alias("x")), ["event", "a"], "left").join(marks.select("event", F.col("source").alias("b"), F.col("mark").alias("y")), ["event", "b"], "left")
    both = both.join(stated, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left")
    same = lambda c: F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    direct = is_(F.col("x.origin") == F.col("b")) | is_(F.col("y.origin") == F.col("a"))
    cluster = F.when(same("cluster"), F.col("x.status"))
    confirmed, suspected, cleared = (is_(cluster == s) for s in ("CONFIRMED_SYNDICATION", "AUTO_SUSPECTED_SYNDICATION", "CONFIRMED_INDEPENDENT"))
    itself = F.col("a") == F.col("b")
    hard = same("origin") | direct | same("content") | same("url")
    relationship = F.when(itself, "RELATED").when(confirmed, "SYNDICATED").when(suspected, "RELATED").when(cleared, "INDEPENDENT").when(hard, "SYNDICATED").when(F.col("stated").isNotNull(), F.col("stated")).when(same("poster"), "RELATED").otherwise("UNKNOWN")
    independence = F.when(F.col("relationship") == "INDEPENDENT", "INDEPENDENT").when(F.col("relationship").isin("RELATED", "SYNDICATED"), "NOT_INDEPENDENT").otherwise("UNKNOWN")
    named = [("SAME_EXPLICIT_ORIGIN", same("origin")), ("DIRECT_ORIGIN_LINK", direct), ("EXACT_CONTENT_FINGERPRINT", same("content")), ("EXACT_POSTER_FINGERPRINT", same("poster")), ("SAME_CANONICAL_URL", same("url")), ("HUMAN_CONFIRMED_CROSS_POST_CLUSTER", confirmed), ("AUTO_SUSPECTED_CROSS_POST", suspected)]
    signals = F.when(itself, F.array(F.lit("SAME_SOURCE"))).otherwise(F.array_compact(F.array(*[F.when(c, name) for name, c in named])))
    return both.withColumn("relationship", relationship).select("event", "a", "b", "relationship", independence.alias("independence"), F.array_join(signals, ",").alias("signals"))


def independent_sources(verdicts: DataFrame) -> DataFrame:
    """event, member of the largest set of sources that greedy search finds independent of each other; none where no pair is."""
    # stored, as the search reads its edges several times
    return greedy_clique(stored(verdicts.filter("independence = 'INDEPENDENT'").select("event", "a", "b"), "independent"), "event")
