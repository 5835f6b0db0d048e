"""Which of several clocks is an event's own, which dates are deadlines, and ordinal weekdays, as column expressions.

A text is split at what is looked for, so that every match is judged by the
pieces before and after it, and nothing needs positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .dates import NEAREST_YEAR_DAYS
from .extraction import _CLOCK, _MARK, _RANGE, _TRAILING, WEEKDAYS, _half, _minutes, time_range

# Words of the programmes that are priced apart, labels of a post's own time, and how near they must be.
OTHER_PROGRAMMES = r"(?i)특강|수업|레슨|클래스|워크샵|워크숍|세미나|패키지|애프터|뒤풀이|뒷풀이|class|lesson|workshop|after\s*party"
TIME_LABEL = r"(?i)(?:시간|일시|시각|Time)\s*[:：]"
NEAR, LABEL_NEAR = 16, 30
# Ordinals of a weekday in its month (-1: the last).
ORDINALS = {"첫째": 1, "첫": 1, "둘째": 2, "두번째": 2, "셋째": 3, "세번째": 3, "넷째": 4, "네번째": 4, "다섯째": 5, "마지막": -1}
# Verdicts on how a time's half of the day is known.
VERDICTS = ("EXPLICIT", "PROPAGATED", "ABSENT")
# Words that name what a deadline closes, and that close it.
_CLOSES = "신청|접수|예매|예약|입금|모집|등록|판매"
_FULL_DAY = r"20[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}"
_BREAK = r"[\n\[\]/|]"


def _pieces(text: Column, form: str) -> tuple[Column, Column]:
    """What lies between the matches of a form (one more than them), and the matches."""
    return F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))


def _tail(piece: Column, match: Column) -> Column:
    """The end of what precedes a match, from the last structural break on; blanks between do not count."""
    return F.when(match.rlike(r"^\s*\n"), "").otherwise(F.element_at(F.split(F.right(F.rtrim(piece), F.lit(NEAR)), _BREAK, -1), -1))


def _head(piece: Column, match: Column) -> Column:
    """The beginning of what follows a match, up to the first structural break."""
    return F.when(match.rlike(r"\n\s*$"), "").otherwise(F.split(F.left(F.ltrim(piece), F.lit(NEAR)), _BREAK, -1)[0])


def _before(tail: Column, words: str) -> Column:
    """Letters between the last of ``words`` in ``tail`` and its end; null without one."""
    return F.when(tail.rlike(words), F.length(F.element_at(F.split(tail, words, -1), -1)))


def _after(head: Column, words: str) -> Column:
    return F.when(head.rlike(words), F.length(F.split(head, words, 2)[0]))


def own_range(text: Column, words: str) -> Column:
    """The range of a text that its event runs at, as ``time_range`` reads it; null if there is none.

    A range whose nearest programme word (a class, an after-party) stands after
    it is that programme's; one before it yields only to a nearer word of the
    event.  Of the others the one nearest to a word of the event (``words``, an
    expression) is its own, the first of two as near, unless it lies strictly
    inside a labelled range that is sure, which then is the whole night's.  No
    word near any: where the text begins with a labelled range the labelled
    ones count, and of those that count the first with a mark on both sides,
    else the first.  A word that directly heads the next range is that one's.
    """
    gaps, found = _pieces(text, _RANGE)

    def judged(bound: Column) -> Column:
        def one(match: Column, k: Column) -> Column:
            before, after = bound.gaps[k], bound.gaps[k + 1]
            last = k == F.size(bound.found) - 1
            sides = F.struct(
                _tail(before, match).alias("tail"),
                # the word right before the next range heads that one
                F.when(last, _head(after, match)).otherwise(_head(F.regexp_replace(after, rf"(?i)(?:{words})[\s:：\[(]*$", ""), match)).alias("head"),
                F.right(before, F.lit(LABEL_NEAR)).rlike(TIME_LABEL).alias("labelled"),
                time_range(match).alias("t"),
            )
            return let(sides, lambda s: weighed(s, k))

        def weighed(s: Column, k: Column) -> Column:
            own_words = f"(?i)(?:{words})"
            near = F.least(_before(s.tail, own_words), _after(s.head, own_words))
            other, behind = _before(s.tail, OTHER_PROGRAMMES), _after(s.head, OTHER_PROGRAMMES)
            foreign = F.coalesce(behind <= F.coalesce(other, behind), F.lit(False)) | (other.isNotNull() & (near.isNull() | (other <= near)))
            ends = s.t.end_min + 1440 * s.t.end_day_offset
            return F.struct(k.alias("k"), near.alias("near"), F.coalesce(foreign, F.lit(False)).alias("foreign"), s.labelled.alias("labelled"), s.t.alias("t"), ends.alias("ends"))

        return F.filter(F.transform(bound.found, one), lambda r: r.t.isNotNull() & ~r.foreign)

    def chosen(ranges: Column) -> Column:
        named = F.array_min(F.transform(F.filter(ranges, lambda r: r.near.isNotNull()), lambda r: F.struct(r.near, r.k)))

        def night(best: Column) -> Column:
            def within(r: Column) -> Column:
                fits = lambda shift: (r.t.start_min <= best.t.start_min + shift) & (best.ends + shift <= r.ends) & ((r.t.start_min != best.t.start_min + shift) | (r.ends != best.ends + shift))
                return r.labelled & ~r.t.ambiguous & (r.k != best.k) & (fits(0) | (best.t.ambiguous & fits(720)))

            return F.coalesce(F.get(F.filter(ranges, within), F.lit(0)).t, best.t)

        def unnamed(pool: Column) -> Column:
            marked = F.filter(pool, lambda r: r.t.evidence == "EXPLICIT")
            return F.coalesce(F.get(marked, F.lit(0)).t, F.get(pool, F.lit(0)).t)

        first = F.get(ranges, F.lit(0))
        pool = F.when(first.labelled, F.filter(ranges, lambda r: r.labelled)).otherwise(ranges)
        by_name = let(named, lambda n: let(F.filter(ranges, lambda r: r.k == n.k)[0], night))
        return F.when(named.isNotNull(), by_name).otherwise(let(pool, unnamed))

    return let(let(F.struct(gaps.alias("gaps"), found.alias("found")), judged), chosen)


# A clock with its marks, and a word that it opens at.
_LONE = rf"{_MARK}?\s*{_CLOCK}{_TRAILING}(?:\s*(부터|시작|[Ss]tart|START))?"


def start_min(text: Column, words: str) -> Column:
    """The minute at which a text that states clocks but no range says that its event starts; null where it does not say.

    Ends (till, until, 까지), hours of 24 and clocks beside another programme's
    word go, as do bare hours without a mark or an opening.  Of clocks near a word of the event one that opens it comes first;
    without such a word, two different clocks decide nothing.  Bare hours up
    to twelve before noon yield to marked ones.
    """
    gaps, found = _pieces(text, _LONE)

    def judged(bound: Column) -> Column:
        def one(match: Column, k: Column) -> Column:
            group = lambda g: F.nullif(F.regexp_extract(match, _LONE, g), F.lit(""))
            sides = F.struct(
                _tail(bound.gaps[k], match).alias("tail"),
                _head(bound.gaps[k + 1], match).alias("head"),
                group(2).try_cast("int").alias("hour"),
                F.coalesce(group(3), group(4), F.lit("0")).try_cast("int").alias("minute"),
                F.coalesce(_half(group(1), group(2).try_cast("int")), _half(group(5), group(2).try_cast("int"))).alias("half"),
                (group(3).isNotNull() | group(6).isNotNull() | (match.contains("시") & (group(2).try_cast("int") >= 13))).alias("clock"),
                group(6).isNotNull().alias("opens"),
            )
            return let(sides, weighed)

        def weighed(s: Column) -> Column:
            own = f"(?i)(?:{words})"
            near, other = F.least(_before(s.tail, own), _after(s.head, own)), F.least(_before(s.tail, OTHER_PROGRAMMES), _after(s.head, OTHER_PROGRAMMES))
            ended = s.head.rlike(r"(?i)^\s*(?:마감|까지|전|이전|until|by)") | s.tail.rlike(r"(?i)(?:\buntil|\btill|~|∼)[\s:：]*$")
            valid = (s.half.isNotNull() | s.clock) & (s.hour < 24) & (s.minute <= 59) & ~ended & (other.isNull() | (near.isNotNull() & (near < other)))
            opens = s.opens | s.tail.rlike(r"(?i)(?:오픈|시작|open|start|부터)[\s:.\-]*$")
            at = _minutes(s.hour, s.minute, s.half)
            weak = s.half.isNull() & s.hour.between(1, 11)
            return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), near.isNotNull().alias("named"), opens.alias("opens"), at.cast("int").alias("at"), weak.alias("weak"), s.half.isNotNull().alias("marked"))

        return F.filter(F.transform(bound.found, one), lambda c: c.valid)

    def chosen(clocks: Column) -> Column:
        strong = F.filter(clocks, lambda c: ~c.weak)
        return let(F.when(F.exists(clocks, lambda c: c.marked), strong).otherwise(clocks), picked)

    def picked(pool: Column) -> Column:
        named = F.filter(pool, lambda c: c.named)
        opening = F.filter(named, lambda c: c.opens)
        alone = F.size(F.array_distinct(F.transform(pool, lambda c: c["at"]))) == 1
        return F.coalesce(F.get(opening, F.lit(0))["at"], F.get(named, F.lit(0))["at"], F.when(alone, pool[0]["at"]))

    return F.when(own_range(text, words).isNull(), let(let(F.struct(gaps.alias("gaps"), found.alias("found")), judged), chosen))


def day_roles(text: Column) -> Column:
    """array<struct(day, role)> of the days that a text writes with a year, in its order: DEADLINE, or EVENT for a day on which something is.

    A deadline is followed by what closes (까지, 마감, until), also after a
    clock, or introduced by one, by a period of registration, or by a tilde
    that begins its field; the end of a range shares the role of its start.
    """
    gaps, found = _pieces(text, _FULL_DAY)
    weekday = r"^\s*(?:\(.{1,3}\))?\s*"
    closed = weekday + rf"(?:[0-9]{{1,2}}\s*(?::\s*[0-9]{{2}}|시)\s*)?(?:(?:{_CLOSES})\s*)?(?:까지|마감|until)"
    opened = rf"(?i)(?:(?:마감|기한|deadline|due)\s*(?:일|은|는)?\s*[:：]?\s*|(?:{_CLOSES}|구매)\s*기간\s*[:：]?\s*|(?:^|[\s:：(\[])[~～]\s*)$"
    joins = weekday + r"(?:[~～–—-]|부터)\s*$"

    def roles(bound: Column) -> Column:
        def one(match: Column, k: Column) -> Column:
            # words that closed the day before introduce nothing here
            before = F.when(k > 0, F.regexp_replace(bound.gaps[k], "(?i)" + closed, "")).otherwise(bound.gaps[k])
            late = bound.gaps[k + 1].rlike("(?i)" + closed) | F.right(before, F.lit(14)).rlike(opened)
            p = F.transform(F.split(match, "[./-]"), lambda x: x.try_cast("int"))
            return F.struct(F.try_to_date(F.format_string("%04d-%02d-%02d", p[0], p[1], p[2]), "yyyy-MM-dd").alias("day"), late.alias("late"), ((k > 0) & bound.gaps[k].rlike(joins)).alias("joined"))

        return F.transform(bound.found, one)

    def told(days: Column) -> Column:
        # the role of a range's start goes on to its end
        start = F.struct(F.lit(False).alias("late"), F.array().cast("array<struct<day:date,role:string>>").alias("out"))

        def step(state: Column, d: Column) -> Column:
            late = F.when(d.joined, state.late).otherwise(d.late)
            return F.struct(late.alias("late"), F.concat(state.out, F.array(F.struct(d.day.alias("day"), F.when(late, "DEADLINE").otherwise("EVENT").alias("role")))).alias("out"))

        return F.filter(F.aggregate(days, start, step, lambda s: s.out), lambda d: d.day.isNotNull())

    return told(let(F.struct(gaps.alias("gaps"), found.alias("found")), roles))


def month_ordinal(text: Column, published: Column) -> Column:
    """The day of "9월 둘째주 토요일" in the year nearest to ``published``, within 200 days; null without such a form."""
    shape = rf"([0-9]{{1,2}})\s*월\s*({'|'.join(sorted(ORDINALS, key=len, reverse=True))})\s*(?:주)?\s*([{''.join(WEEKDAYS)}])요일"
    ordinal = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    asked = F.struct(
        F.regexp_extract(text, shape, 1).try_cast("int").alias("month"),
        F.element_at(ordinal, F.regexp_extract(text, shape, 2)).alias("n"),
        (F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.regexp_extract(text, shape, 3)).cast("int") - 1).alias("weekday"),
        F.year(published).alias("year"),
    )

    def nth(first: Column, a: Column) -> Column:
        last = F.last_day(first)
        day = F.when(a.n > 0, F.date_add(first, (a.weekday - F.weekday(first) + 7) % 7 + 7 * (a.n - 1))).otherwise(F.date_sub(last, (F.weekday(last) - a.weekday + 7) % 7))
        return F.when(day <= last, day)

    def of_years(a: Column) -> Column:
        return F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: let(F.try_to_date(F.format_string("%04d-%02d-01", a.year + k, a.month), "yyyy-MM-dd"), lambda first: nth(first, a)))

    days = let(asked, of_years)
    near = F.array_min(F.transform(F.filter(days, lambda d: d.isNotNull()), lambda d: F.struct(F.abs(F.datediff(d, published)).alias("far"), d.alias("day"))))
    return F.when(text.rlike(shape) & published.isNotNull(), let(near, lambda n: F.when(n.far <= NEAREST_YEAR_DAYS, n.day)))


def time_verdict(inference: Column, value: Column) -> Column:
    """How a stored time's half of the day is known: the inference's own word, else that of the reading (JSON) in ``value``.

    UNAMBIGUOUS where no mark is needed; null where neither is a verdict, as
    the inference of a time read off an image points to the image.
    """
    read = F.get_json_object(value, "$.meridiem_evidence")
    verdict = F.when(inference.isin(*VERDICTS), inference).when(read.isin(*VERDICTS), read)
    return F.when((verdict == "ABSENT") & (F.get_json_object(value, "$.ambiguous") == "false"), "UNAMBIGUOUS").otherwise(verdict)
