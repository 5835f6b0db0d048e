"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans.  Labelers vote on each: does it pass its kind's check,
does a gazetteer know its ending, prefix, range, name or place, does the text
before it cue its kind, does the text after it go on as its kind does, does it
stand free.  Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability without any truth; the posteriors
then train a naive Bayes classifier on votes and shape, which decides the spans
that the base patterns alone would drop.  Base spans always stay.

Only counts of vote patterns reach the driver: at most kinds * 3^labelers *
shapes rows, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Patterns of the base kinds, in the order in which spans are listed.  Possessive quantifiers and the
# look-behinds change no match (they only save retries that cannot succeed); they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Patterns of the kinds that only the method adds: number groups written as national ids are, bank account
# numbers, addresses in the ways of four languages, and personal names.
ADDED = {
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|St|Ave|Rd|Ln|Dr|Blvd)(?![A-Za-z])"
    r"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|allee)\x20[0-9]{1,4}(?![0-9])"
    r"|(?<![0-9])[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place)\x20(?:d[eu]s?\x20|la\x20|l')*[A-ZÀ-Ý][a-zà-ÿ]+"
    r"|(?:Calle|Avenida|Plaza)\x20(?:de\x20|la\x20|del\x20)*[A-ZÁ-Ú][a-zá-ú]+,?\x20[0-9]{1,4}(?![0-9])",
    "name": r"(?<![\p{L}])\p{Lu}\p{Ll}+\x20(?:\p{Lu}[.]\x20)?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?![\p{L}])",
}
KINDS = (*PATTERNS, *ADDED)

# Gazetteers and cues.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "us", "eu", "it", "nl", "ch", "at", "pl", "ru", "jp", "cn", "in", "br", "ca", "au", "mx", "kr")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "353", "358", "380", "420", "852", "886", "971", "972")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "6011", "62", "64", "65")
# Frequent given names, family names and towns of the languages' countries.
GIVEN_NAMES = (
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen "
    "emma olivia sophia daniel matthew anthony mark paul steven andrew laura anna maria peter hans klaus jürgen stefan andreas monika sabine petra ursula heike "
    "jean pierre michel philippe alain jacques nathalie isabelle sylvie catherine camille louis chloé josé antonio manuel francisco juan carlos miguel luis "
    "carmen ana isabel dolores pilar teresa lucía alejandro javier"
).split()
FAMILY_NAMES = (
    "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson white harris martin thompson clark lewis walker hall young king "
    "müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf bernard dubois durand moreau laurent simon "
    "lefebvre leroy roux david bertrand petit garcía gonzález rodríguez fernández lópez martínez sánchez pérez gómez díaz ruiz hernández álvarez"
).split()
PLACES = (
    "london manchester birmingham dublin york chicago boston houston seattle denver austin berlin hamburg münchen munich köln frankfurt stuttgart leipzig "
    "wien zürich paris lyon marseille toulouse lille bordeaux nantes madrid barcelona valencia sevilla bilbao zaragoza málaga"
).split()
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|client|login",
    "card": "card|visa|master|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|tel\b|tel[.:]|call|fax|mobile|whatsapp",
    "id": r"ssn|social security|\bid\b|identity|tax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "address": "address|live|office|visit|adresse|wohn|domicil|habite|dirección",
    "name": r"\b(?:mr|mrs|ms|dr|herr|frau|señora?|sra?|monsieur|madame|mme|name|nom|nombre|by|from|dear|signed)[.:]?\x20*$",
}
#: What goes on behind a span of a kind.
SEQUELS = {
    "address": r"^,?\x20*(?:[0-9]{4,5}\b|[a-z]{2}\x20[0-9]{5}|" + "|".join(PLACES) + ")",
    "name": r"^,?\x20*(?:<|\(|born|aged|phone|tel|e-?mail|[a-z0-9._%+-]+@)",
    "phone": r"^\x20*(?:ext|x)[.\x20]*[0-9]",
    "card": r"^[,;\x20]*(?:exp|cvv|cvc|valid)",
}
LABELERS = ("check", "gazetteer", "cue", "free", "sequel")
#: Code points of text before and after a span that labelers see.
CONTEXT = 40
#: A span beyond the base ones is added from this probability.
SURE = 0.9
ROUNDS = 30

# Quick tests that no text with a match fails.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "address": lambda t: t.rlike(r"[0-9]"),
    "name": lambda t: t.rlike(r"\p{Lu}\p{Ll}+\x20(?:\p{Lu}[.]\x20)?\p{Lu}\p{Ll}"),
}


def _matches(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches of a kind's pattern and the texts between them."""
    pattern = F.lit({**PATTERNS, **ADDED}[kind])
    may = _MAY[kind](text)
    nothing = F.array().cast("array<string>")
    return F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(nothing), F.when(may, F.split(text, pattern, -1)).otherwise(nothing)


#: Prefix sums go over so many matches at once, then over the sums, so that a text of many matches costs in proportion.
_RUN = 256


def _running(start: Column, numbers: Column) -> Column:
    """``start`` and its sums with the numbers so far: one element more than ``numbers``."""
    return F.aggregate(numbers, F.array(start), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))


def _with_spans(found: DataFrame) -> DataFrame:
    """doc_id and spans, an array<struct<kind, start, end, value, before, after>>, from columns of matches and gaps; code points, end exclusive."""
    zero = F.lit(0).cast("long")
    every = lambda column: [column(k).alias(f"{k}_{name}") for k in KINDS]
    name = "runs"
    lengths = {k: F.transform(f"{k}_hits", lambda v, i: (F.length(v) + F.length(F.col(f"{k}_gaps")[i])).cast("long")) for k in KINDS}  # noqa: B023
    last = lambda k: F.floor((F.size(f"{k}_hits") - 1) / F.lit(_RUN)).cast("int")
    found = found.select("*", *[lengths[k].alias(f"{k}_lengths") for k in KINDS])
    found = found.select("*", *every(lambda k: F.transform(F.sequence(F.lit(0), last(k)), lambda r: F.slice(f"{k}_lengths", r * _RUN + 1, F.lit(_RUN)))))
    name = "bases"
    found = found.select("*", *every(lambda k: _running(zero, F.transform(f"{k}_runs", lambda run: F.aggregate(run, zero, lambda s, n: s + n)))))
    name = "ends"
    found = found.select("*", *every(lambda k: F.flatten(F.zip_with(f"{k}_runs", F.slice(f"{k}_bases", F.lit(1), F.size(f"{k}_runs")), lambda run, base: F.slice(_running(base, run), F.lit(2), F.size(run))))))

    def spans(k: str) -> Column:
        gaps = F.col(f"{k}_gaps")
        span = lambda v, i: F.struct(
            F.lit(k).alias("kind"), (F.col(f"{k}_ends")[i] - F.length(v)).alias("start"), F.col(f"{k}_ends")[i].alias("end"), v.alias("value"), F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after")
        )
        return F.transform(f"{k}_hits", span)

    return found.select("doc_id", F.flatten(F.array(*[spans(k) for k in KINDS])).alias("spans"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: (F.ascii(F.substr(back, i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _iban(value: Column) -> Column:
    """Whether the number leaves 1 when divided by 97, its first four characters last and letters read as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substr(turned, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda s, c: F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)) == 1


def passes(span: Column) -> Column:
    """Whether a span passes its kind's check; spans that do, of the base kinds, are the base ones."""
    digits = _digits(span.value)
    n = F.length(digits)
    return (
        F.when(span.kind == "ip", F.forall(F.split(span.value, "[.]"), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(span.kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(span.kind == "phone", n.between(9, 15))
        .when(span.kind == "id", ~span.value.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(span.kind == "iban", _iban(span.value))
        .when(span.kind == "name", F.lower(F.substring_index(span.value, " ", 1)).isin(*GIVEN_NAMES))
        .otherwise(F.lit(True))
    )


def _any_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    return text.rlike("^(?:" + "|".join(prefixes) + ")")


def _votes(span: Column) -> Column:
    """One character for each labeler: 1, 0, or - where it abstains."""
    digits = _digits(span.value)
    known = (
        F.when(span.kind == "email", F.lower(F.substring_index(span.value, ".", -1)).isin(*ENDINGS))
        .when(span.kind == "phone", _any_prefix(digits, CALLING_CODES))
        .when(span.kind == "card", _any_prefix(digits, CARD_PREFIXES))
        .when(span.kind == "ip", ~span.value.rlike(r"^(?:0+|2[3-5][0-9]|22[4-9])[.]"))
        .when(span.kind == "iban", span.value.rlike("^(?:" + "|".join(IBAN_COUNTRIES) + ")"))
        .when(span.kind == "name", F.lower(F.substring_index(span.value, " ", -1)).isin(*FAMILY_NAMES))
        .when(span.kind == "address", F.when(F.lower(F.concat(span.before, F.lit(" "), span.after)).rlike(r"\b(?:" + "|".join(PLACES) + r")\b"), F.lit(True)))
    )
    cue = F.lit(None).cast("boolean")
    for kind, words in CUES.items():
        cue = F.when(span.kind == kind, F.when(F.lower(span.before).rlike(words), F.lit(True))).otherwise(cue)
    sequel = F.lit(None).cast("boolean")
    for kind, words in SEQUELS.items():
        sequel = F.when(span.kind == kind, F.when(F.lower(span.after).rlike(words), F.lit(True))).otherwise(sequel)
    free = ~(span.before.rlike("[A-Za-z0-9]$") | F.coalesce(span.after, F.lit("")).rlike("^[A-Za-z0-9]"))
    shown = [F.when(v.isNull(), "-").when(v, "1").otherwise("0") for v in (passes(span), known, cue, free, sequel)]
    return F.concat(*shown)


def _shape(span: Column) -> Column:
    """Length class and separators, as a short string."""
    return F.concat(F.least(F.floor(F.length(span.value) / 6), F.lit(5)).cast("string"), F.when(span.value.rlike(r"[\x20().-]"), "s").otherwise("p"))


def proposed(docs: DataFrame) -> DataFrame:
    """doc_id, base and other of every row: arrays of struct<kind, start, end, votes, shape>; other spans overlap no base span."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    found = found.select("doc_id", *[c.alias(f"{k}_{part}") for k in KINDS for part, c in zip(("hits", "gaps"), _matches(F.col("text"), k))])
    found = _with_spans(found)
    judged = F.transform("spans", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), _votes(s).alias("votes"), _shape(s).alias("shape")))
    found = found.select("doc_id", judged.alias("spans"))
    is_base = lambda s: s.kind.isin(*PATTERNS) & s.votes.startswith("1")
    found = found.select("doc_id", "spans", F.filter("spans", is_base).alias("base"))
    apart = lambda s: ~F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end))
    return found.select("doc_id", "base", F.filter("spans", lambda s: ~is_base(s) & apart(s)).alias("other"))


def reliabilities(patterns: dict[tuple[str, str], float], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[tuple[str, int], tuple[float, float]]]:
    """EM over counts of (kind, votes): each kind's prior, and each (kind, labeler)'s chance of voting 1 on true and false spans."""
    kinds = sorted({k for k, _ in patterns})
    prior = {k: 0.5 for k in kinds}
    rate = {(k, j): (0.8, 0.2) for k in kinds for j in range(len(LABELERS))}
    for _ in range(rounds):
        mass: dict[str, list[float]] = {k: [1.0, 1.0] for k in kinds}
        ones = {key: [0.8, 0.2] for key in rate}
        seen = {key: [1.0, 1.0] for key in rate}
        for (kind, votes), n in patterns.items():
            p = posterior(kind, votes, prior, rate)
            for side, share in enumerate((p * n, (1 - p) * n)):
                mass[kind][side] += share
                for j, v in enumerate(votes):
                    if v != "-":
                        seen[kind, j][side] += share
                        ones[kind, j][side] += share * (v == "1")
        prior = {k: m[0] / sum(m) for k, m in mass.items()}
        rate = {key: (ones[key][0] / seen[key][0], ones[key][1] / seen[key][1]) for key in rate}
        # a labeler that speaks for falsehood would swap the classes: the check is held to be better than chance
        for k in kinds:
            yes, no = rate[k, 0]
            rate[k, 0] = (max(yes, 0.6), min(no, 0.4))
    return prior, rate


def posterior(kind: str, votes: str, prior: dict[str, float], rate: dict[tuple[str, int], tuple[float, float]]) -> float:
    odds = math.log(prior[kind] / (1 - prior[kind]))
    for j, v in enumerate(votes):
        if v != "-":
            yes, no = rate[kind, j]
            odds += math.log(yes / no) if v == "1" else math.log((1 - yes) / (1 - no))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def classifier(counts: dict[tuple[str, str, str], float], rounds: int = ROUNDS) -> dict[tuple[str, str, str], float]:
    """Probability of each (kind, votes, shape), by naive Bayes on votes and shape, trained on the posteriors of the votes."""
    patterns: dict[tuple[str, str], float] = {}
    for (kind, votes, _), n in counts.items():
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    prior, rate = reliabilities(patterns, rounds)
    weight: dict[tuple, list[float]] = {}
    for (kind, votes, shape), n in counts.items():
        p = posterior(kind, votes, prior, rate)
        for feature in ((kind,), *((kind, j, v) for j, v in enumerate(votes)), (kind, "shape", shape)):
            both = weight.setdefault(feature, [1.0, 1.0])
            both[0] += n * p
            both[1] += n * (1 - p)
    out = {}
    for kind, votes, shape in counts:
        yes, no = weight[kind,]
        odds = math.log(yes / no)
        for feature in (*((kind, j, v) for j, v in enumerate(votes)), (kind, "shape", shape)):
            a, b = weight[feature]
            odds += math.log((a / yes) / (b / no))
        out[kind, votes, shape] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return out


def find_pii(docs: DataFrame, sure: float = SURE, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_added, n_spans, base_sha256, spans.

    ``base_sha256`` digests the base spans as kind:start:end by kind as listed,
    then start; ``spans`` lists them with those that the classifier adds (of
    the base kinds, though their check fails, or of the kinds in ADDED); those
    overlap no base span, but may overlap each other.  Null and empty text have
    none.  Spans that tie in kind and start go by end.  Repeated rows repeat;
    other columns play no part.  No rows in: no rows out.
    """
    found = stored(proposed(docs), "pii")
    every = found.select(F.explode(F.concat("base", "other")).alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n"))
    chances = classifier({(r["kind"], r["votes"], r["shape"]): float(r["n"]) for r in every.collect()}, rounds)
    keys = sorted("|".join(k) for k, p in chances.items() if p >= sure)
    taken = F.filter("other", lambda s: F.concat_ws("|", s.kind, s.votes, s.shape).isin(*keys)) if keys else F.filter("other", lambda s: F.lit(False))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s.kind)

    def listed(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    added = F.size(taken).cast("long")
    totals = [added.alias("n_added"), (F.size("base") + added).cast("long").alias("n_spans")]
    return found.select("doc_id", *[count(k) for k in PATTERNS], *totals, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat(F.col("base"), taken)).alias("spans"))
