"""From raw posts to dated candidates: classification, extraction, evidence, verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extraction
from ..functions.text import occurs_any

@dataclass(frozen=True)
class Vocabulary:
    """The words by which a post is told to be of a kind; a scene with others passes its own."""

    recaps: Sequence[str] = ("후기", "사진", "영상", "recap", "photos", "review")
    classes: Sequence[str] = ("강습", "수업", "워크샵", "워크숍", "class", "course", "lesson", "workshop")
    milongas: Sequence[str] = ("밀롱가", "milonga")
    socials: Sequence[str] = ("소셜", "파티", "정모", "social", "party")
    doors: Sequence[str] = ("입장", "오픈", "doors", "open")
    courses: Sequence[str] = ("개강", "수강", "회차", "weeks", "enrol", "register")
    open_classes: Sequence[str] = ("오픈클래스", "오픈 클래스", "원데이", "open class", "taster")
    lessons: Sequence[str] = ("특강", "강좌", "레슨", "seminar", "masterclass")
    night_categories: Sequence[str] = ("SOCIAL", "PARTY", "NIGHT")
    course_categories: Sequence[str] = ("LESSON", "COURSE")


VOCABULARY = Vocabulary()
#: Fields that verification asks for, and roles whose word counts.
CORE = ("event_date", "start_min", "end_min", "fee")
TRUSTED = ("ORGANIZER", "OFFICIAL", "VENUE")
# States of a field, strongest first.
FIELD_STATES = ("CONFLICT", "VERIFIED", "EXPECTED", "INFERRED", "UNKNOWN")


def any_of(words: Sequence[str], text: Column) -> Column:
    """Whether any of the words occurs in a text, in one search of it."""
    return F.coalesce(occurs_any(words, text), F.lit(False))


def evidence(title: Column, body: Column, published: Column, words: Vocabulary = VOCABULARY) -> Column:
    """struct of booleans: what a post's own words prove, each by a rule of its own.

    - ``social``: a social word in the title, or in a line that also states a clock;
    - ``party``: a day, an opening of doors with a clock, and a price, together;
    - ``course``: sold as a course: a class word with enrolment or a number of sessions;
    - ``night``: a night word in the title, and a day and a clock in the text;
    - ``recap``: a recap word in the title.
    """
    whole, lines = F.concat_ws("\n", title, body), F.split(F.coalesce(body, F.lit("")), "\n")
    clock = extraction.time_range(whole).isNotNull()
    day, priced = extraction.event_date(whole, published).isNotNull(), extraction.fee(whole).getField("amount").isNotNull()
    timed = lambda line: line.rlike(r"[0-9]{1,2}\s*(?::[0-9]{2}|시|[ap]m)") | line.rlike(r"(?i)[ap]m\s*[0-9]")
    social = any_of(words.socials, title) | F.exists(lines, lambda line: any_of(words.socials, line) & timed(line))
    opening = F.exists(lines, lambda line: any_of(words.doors, line) & timed(line))
    course = any_of(words.classes, whole) & (any_of(words.courses, whole) | whole.rlike(r"(?i)[0-9]+\s*(?:주|회|weeks|sessions)"))
    night = any_of([*words.milongas, *words.socials], title) & day & clock
    return F.struct(social.alias("social"), (day & opening & priced).alias("party"), course.alias("course"), night.alias("night"), any_of(words.recaps, title).alias("recap"))


def kind(title: Column, body: Column, known: Column, words: Vocabulary = VOCABULARY) -> Column:
    """The kind of event a post announces; the first rule that holds decides.

    A recap is no event whatever its board says; a collector's own knowledge
    comes next; a post that teaches and dances is both.
    """
    whole = F.concat_ws(" ", title, body)
    teaches, milonga, social = (any_of(w, whole) for w in (words.classes, words.milongas, words.socials))
    return (
        F.when(any_of(words.recaps, title), "OTHER")
        .when(known.isNotNull(), known)
        .when(milonga & teaches, "MILONGA_WITH_CLASS")
        .when(social & teaches, "SOCIAL_WITH_CLASS")
        .when(teaches, "CLASS")
        .when(milonga, "MILONGA")
        .when(social, "SOCIAL")
        .otherwise("OTHER")
    )


def traits(title: Column, body: Column, published: Column, category: Column, words: Vocabulary = VOCABULARY) -> Column:
    """``evidence`` and what else the decision list asks: struct of booleans.

    - ``teaches``: a class word anywhere; ``open_class``: one open to all;
    - ``lesson_title``: the title sells a lesson in other words;
    - ``night_word``: a night word anywhere; ``own_night``: one in the title, and one in a line with a clock of its own;
    - ``listed_night``: the source files it under nights, and it states a day and a clock;
    - ``notice``: a day, a clock and a named place, whatever it calls itself;
    - ``course`` also where the source files it under courses.
    """
    whole, lines = F.concat_ws("\n", title, body), F.split(F.coalesce(body, F.lit("")), "\n")
    day, clock = extraction.event_date(whole, published).isNotNull(), extraction.time_range(whole).isNotNull()
    timed = lambda line: line.rlike(r"[0-9]{1,2}\s*(?::[0-9]{2}|시|[ap]m)") | line.rlike(r"(?i)[ap]m\s*[0-9]")
    more = {
        "teaches": any_of(words.classes, whole),
        "open_class": any_of(words.open_classes, whole),
        "lesson_title": any_of(words.lessons, title),
        "night_word": any_of(words.milongas, whole),
        "own_night": any_of(words.milongas, title) & F.exists(lines, lambda line: any_of(words.milongas, line) & timed(line)),
        "listed_night": F.coalesce(category.isin(*words.night_categories), F.lit(False)) & day & clock,
        "notice": day & clock & extraction.venue(whole).isNotNull(),
    }
    known = evidence(title, body, published, words)
    more["course"] = known["course"] | F.coalesce(category.isin(*words.course_categories), F.lit(False))
    return F.struct(*[known[c].alias(c) for c in ("social", "party", "night", "recap")], *[v.alias(c) for c, v in more.items()])


#: The decision list: rule, what must hold, and the kind it gives (in small letters: the column that has it).
RULES = (
    ("recap", lambda t: t.recap, "OTHER"),
    ("known board", lambda t: F.col("known_kind").isNotNull(), "known_kind"),
    ("festival record", lambda t: F.coalesce(F.col("record_format") == "FESTIVAL", F.lit(False)), "FESTIVAL"),
    ("open class of a night", lambda t: t.teaches & t.night_word & t.open_class, "MILONGA_WITH_CLASS"),
    ("social that teaches", lambda t: t.teaches & t.social & ~t.course, "SOCIAL_WITH_CLASS"),
    ("party that teaches", lambda t: t.teaches & t.party, "SOCIAL_WITH_CLASS"),
    ("night that teaches", lambda t: t.teaches & t.night, "MILONGA_WITH_CLASS"),
    ("listed night that teaches", lambda t: t.teaches & t.listed_night, "SOCIAL_WITH_CLASS"),
    ("class", lambda t: t.teaches, "CLASS"),
    ("social with a lesson", lambda t: t.lesson_title & t.social & ~t.course, "SOCIAL_WITH_CLASS"),
    ("party with a lesson", lambda t: t.lesson_title & t.party, "SOCIAL_WITH_CLASS"),
    ("lesson", lambda t: t.lesson_title & ~t.own_night, "CLASS"),
    ("course", lambda t: ~t.lesson_title & t.course, "CLASS"),
    ("night", lambda t: t.night_word, "MILONGA"),
    ("social", lambda t: t.social, "SOCIAL"),
    ("notice", lambda t: t.notice, "SOCIAL"),
    ("structure", lambda t: F.coalesce(F.col("fallback").isin("MILONGA", "SOCIAL", "MILONGA_WITH_CLASS", "SOCIAL_WITH_CLASS"), F.lit(False)), "fallback"),
)


def given(kind: str) -> Column:
    return F.col(kind) if kind.islower() else F.lit(kind)


def classified(posts: DataFrame, words: Vocabulary = VOCABULARY) -> DataFrame:
    """``posts`` with kind and rule: the first rule of the list that holds, OTHER without any.

    ``posts`` has title, body, published, category (the source's own),
    known_kind (a board of one kind), record_format and fallback (what a
    source's structure says where words say nothing).  A recap is no event
    whatever its board says; a post that sells a course is no social for
    mentioning one; structure never overrules words.
    """
    read = posts.withColumn("_t", traits(F.col("title"), F.col("body"), F.col("published"), F.col("category"), words))
    chosen = F.coalesce(*[F.when(holds(F.col("_t")), F.struct(F.lit(name).alias("rule"), given(kind).alias("kind"))) for name, holds, kind in RULES], F.struct(F.lit("none").alias("rule"), F.lit("OTHER").alias("kind")))
    return read.withColumn("_c", chosen).select(*posts.columns, F.col("_c.kind").alias("kind"), F.col("_c.rule").alias("rule"))


def candidates(posts: DataFrame) -> DataFrame:
    """One candidate for each dated segment of a post: post_id, nth, kind, event_date, start_min, end_min, end_day_offset, fee, fee_options, venue.

    ``posts`` has post_id, title, body, published (date), known_kind.  A post
    whose segments resolve to fewer than two days gives one candidate of its
    whole text.  A place that only one segment names is shared by the others.
    Posts are dealt out by post_id before they are read: the readers are the
    costly part, and the windows by post then need no other shuffle.
    """
    text = F.concat_ws("\n", "title", "body")
    posts = posts.repartition("post_id")
    parts = posts.select("post_id", "title", "published", kind(F.col("title"), F.col("body"), F.col("known_kind")).alias("kind"), F.posexplode_outer(extraction.segments(text)).alias("nth", "part")).filter("nth is not null")
    read = parts.select("*", extraction.event_date(F.col("part"), F.col("published")).alias("event_date"), extraction.time_range(F.col("part")).alias("t"), extraction.fee(F.col("part")).alias("f"), extraction.venue(F.col("part")).alias("own_venue"))
    post = Window.partitionBy("post_id")
    # least and greatest tell whether there are two, without a set for each post
    several = lambda c: F.coalesce(F.min(c).over(post) < F.max(c).over(post), F.lit(False))
    read = read.withColumns({"dated": several("event_date"), "shared": F.max("own_venue").over(post), "named": several("own_venue")})
    rank = F.row_number().over(Window.partitionBy("post_id", F.when(F.col("dated"), F.col("event_date"))).orderBy(F.col("event_date").isNull(), F.col("t").isNull(), "nth"))
    kept = read.withColumn("rank", rank).filter("rank = 1 and (not dated or event_date is not null)")
    venue = F.coalesce("own_venue", F.when(~F.col("named"), F.col("shared")))
    return kept.select("post_id", "nth", "kind", "event_date", "t.start_min", "t.end_min", "t.end_day_offset", F.col("t.evidence").alias("time_evidence"), F.col("f.amount").alias("fee"), F.col("f.options").alias("fee_options"), venue.alias("venue"))


def evidences(found: DataFrame) -> DataFrame:
    """Candidates unpivoted: post_id, nth, field, value, one row for every field that is known."""
    fields = [c for c in ("event_date", "start_min", "end_min", "fee", "venue") if c in found.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    return found.select("post_id", "nth", F.explode(pairs).alias("e")).select("post_id", "nth", "e.*").filter("value is not null")


def field_states(evidence: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, field, state, value of evidence (key, field, value, role, kind): two trusted values are a conflict; TEXT from a trusted role verifies, any TEXT is expected, the rest inferred."""
    trusted = F.col("role").isin(*TRUSTED) & (F.col("kind") == "TEXT")
    grouped = evidence.groupBy(*key, "field").agg(
        F.countDistinct(F.when(trusted, F.col("value"))).alias("sure"),
        F.max(F.when(trusted, F.col("value"))).alias("sure_value"),
        F.max(F.when(F.col("kind") == "TEXT", F.col("value"))).alias("text_value"),
        F.max("value").alias("any_value"),
    )
    state = F.when(F.col("sure") > 1, "CONFLICT").when(F.col("sure") == 1, "VERIFIED").when(F.col("text_value").isNotNull(), "EXPECTED").when(F.col("any_value").isNotNull(), "INFERRED").otherwise("UNKNOWN")
    return grouped.select(*key, "field", state.alias("state"), F.when(F.col("sure") <= 1, F.coalesce("sure_value", "text_value", "any_value")).alias("value"))


def verified(states: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, verified, confidence: every core field verified and no conflict anywhere."""
    core = F.count_if(F.col("field").isin(*CORE) & (F.col("state") == "VERIFIED"))
    clash = F.coalesce(F.bool_or(F.col("state") == "CONFLICT"), F.lit(False))
    confidence = F.when(clash, "CONFLICT").when(core == len(CORE), "VERIFIED").when(core > 0, "POSSIBLE").otherwise("DISCOVERED")
    return states.groupBy(*key).agg(((core == len(CORE)) & ~clash).alias("verified"), confidence.alias("confidence"))


def revision(title: Column) -> Column:
    """ORIGINAL, UPDATE or CANCELLATION, by the words of a title."""
    return F.when(title.rlike("(?i)취소|cancel"), "CANCELLATION").when(title.rlike("(?i)변경|수정|update|changed"), "UPDATE").otherwise("ORIGINAL")


def corrected(rows: DataFrame, corrections: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` under human corrections (key, field, value, at): the newest of a field wins, and an explicit null clears it."""
    newest = corrections.groupBy(key, "field").agg(F.max_by(F.struct("value"), "at").alias("v"))
    wide = newest.groupBy(key).pivot("field", list(columns)).agg(F.first("v"))
    named = wide.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(named, key, "left")
    types = dict(rows.dtypes)
    return joined.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}").getField("value").cast(types[c])).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def festivals(posts: DataFrame) -> DataFrame:
    """post_id, first_day, last_day, night for every day of the period that a post (post_id, title, body) states."""
    period = extraction.festival_period(F.concat_ws("\n", "title", "body"))
    found = posts.select("post_id", period.alias("p")).filter("p is not null")
    return found.select("post_id", "p.first_day", "p.last_day", F.explode(extraction.nights(F.col("p"))).alias("night"))


def programmes(posts: DataFrame) -> DataFrame:
    """post_id, nth, name, start_min, end_min, end_day_offset of every programme line of a post."""
    # an inner explode would have Spark read the lines for its own filters too
    found = posts.select("post_id", F.posexplode_outer(extraction.programmes(F.col("body"))).alias("nth", "p")).filter("nth is not null")
    return found.select("post_id", "nth", "p.name", "p.time.start_min", "p.time.end_min", "p.time.end_day_offset")


def weekly(posts: DataFrame) -> DataFrame:
    """post_id, day, start_min, end_min of every open weekday line of a post (post_id, body, published)."""
    parts = posts.select("post_id", F.explode(extraction.weekday_sections(F.col("body"), F.col("published"))).alias("s"))
    return parts.select("post_id", "s.day", extraction.time_range(F.col("s.part")).alias("t")).select("post_id", "day", "t.start_min", "t.end_min")


def filled_from_images(found: DataFrame, ocr: DataFrame) -> DataFrame:
    """Candidates whose missing date, clock, fee or place come from the text of the post's images, with what was filled and what conflicts.

    ``ocr`` has post_id, ocr_text, published; a place is taken only from a label.
    """
    text, day = F.col("ocr_text"), F.col("published")
    read = ocr.select("post_id", extraction.event_date(text, day).alias("o_date"), extraction.time_range(text).alias("o_time"), extraction.fee(text).alias("o_fee"), extraction.venue(text).alias("o_venue"))
    joined = found.join(read, "post_id", "left")
    pairs = (("event_date", F.col("o_date")), ("start_min", F.col("o_time.start_min")), ("fee", F.col("o_fee.amount")), ("venue", F.col("o_venue")))
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull() & o.isNotNull(), F.lit(c)) for c, o in pairs]))
    clash = F.array_compact(F.array(*[F.when(F.col(c) != o, F.lit(c)) for c, o in pairs[:2]]))
    own = [c for c in found.columns if c not in dict(pairs)]
    return joined.select(*own, *[F.coalesce(F.col(c), o).alias(c) for c, o in pairs], F.array_join(filled, ",").alias("filled"), F.array_join(clash, ",").alias("conflicts"))
