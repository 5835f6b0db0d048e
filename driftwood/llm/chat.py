"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, message, seq, kind, role, text) is folded by
conversation and message in order of seq:

- ``message`` sets the role and the text, ``delta`` adds to the text (the first
  one also sets the role), ``edit`` replaces the text;
- ``regenerate`` starts the message again with its text and takes back every
  event before it of all later messages.

Final messages are rendered with turn marks; text and role are escaped so that
neither can hold a mark.  A loss mask lists the spans of the assistant's texts.
Folding is spread by (conversation, message), and costs in proportion to a
message's events; only the rendered string of a conversation is ever in one
place.  A conversation is one string, so it must fit a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = "<|turn|>"
END = "<|end|>\n"
LEARNER = "assistant"
#: Escapes, applied in this order and undone in the opposite one.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def messages(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: what each message is after all events.

    ``message`` may be of any type with an order.  Null text is empty, null
    role is empty, null kind is ``delta``; ties of seq go by kind, role, text.
    Unknown kinds raise nothing and change nothing.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    event = F.struct(F.col("seq"), kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("events"), F.max(F.when(kind == "regenerate", F.col("seq"))).alias("again"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("cut", F.max("again").over(earlier))
    folded = folded.withColumn("events", F.when(F.col("cut").isNull(), F.col("events")).otherwise(F.filter("events", lambda e: e.seq > F.col("cut")))).filter(F.size("events") > 0)

    # the text is that of the last event that sets it, and of the deltas behind that
    sets = lambda e: e.kind.isin("message", "regenerate", "edit")
    marked = folded.withColumn("from", F.greatest(F.lit(1), F.array_max(F.transform("events", lambda e, i: F.when(sets(e), i + 1).otherwise(F.lit(0))))))
    since = F.slice("events", F.col("from"), F.size("events"))
    text = F.array_join(F.transform(F.filter(since, lambda e: sets(e) | (e.kind == "delta")), lambda e: e.text), "")
    # the role is the last that a message or a regeneration names, else the first that any event names
    named = F.filter("events", lambda e: e.role != "")
    by_start = F.filter(named, lambda e: e.kind.isin("message", "regenerate"))
    role = F.coalesce(F.try_element_at(by_start, F.lit(-1))["role"], F.try_element_at(named, F.lit(1))["role"], F.lit(""))
    return marked.select("conv_id", "message", role.alias("role"), text.alias("text"))


def formatted(events: DataFrame, learner: str = LEARNER) -> DataFrame:
    """conv_id, formatted, loss_mask (spans of code points, end exclusive) of each conversation in ``events``."""
    turns = messages(events)
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    body = escaped(F.col("text"))
    turns = turns.select("conv_id", "message", (F.col("role") == learner).alias("learnt"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), F.concat(head, body, F.lit(END)).alias("shown"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("head") + F.col("body") + len(END)).over(before), F.lit(0)) + F.col("head")
    turns = turns.withColumn("span", F.when(F.col("learnt"), F.struct(start.alias("start"), (start + F.col("body")).alias("end"))))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "shown", "span"))).alias("turns"))
    return whole.select("conv_id", F.array_join("turns.shown", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_mask"))


def turns_of(text: Column) -> Column:
    """The (role, text) of every turn, read back from a formatted conversation."""
    parts = F.split(text, END.replace("|", "[|]"), -1)
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(HEAD) + 1, 1 << 30))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(F.substr(p, F.length(role) + 2)).alias("text"))

    return F.transform(bodies, turn)


def learnt_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(mask, lambda s: F.substr(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))), ""))


def events_of(conversations: DataFrame) -> DataFrame:
    """Events of rows (conv_id, turn, role, text): every row is a message of its own, by turn; rows that share a turn go by role, text."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    place = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), F.row_number().over(same).alias("nth"))
    return conversations.select("conv_id", place.alias("message"), F.coalesce("turn", F.lit((1 << 63) - 1)).alias("seq"), F.lit("message").alias("kind"), "role", "text")


#: Longest piece of a streamed answer.
DELTA_CHARS = 400


def logged(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log that a service might have kept of rows (conv_id, turn, role, text), as events in no order.

    Learner's turns are streamed: the first answer, the text in capitals, is
    broken off and regenerated, and the text then comes in deltas of at most
    ``delta_chars`` code points.  Other turns are sent with a slip, which an
    edit mends.  Folded, every message has its row's role and text again.
    """
    first = events_of(conversations).withColumn("text", F.coalesce("text", F.lit("")))
    step = lambda k: F.struct("message.turn", "message.nth", (F.lit(k) if isinstance(k, int) else k).alias("step"))
    event = lambda k, kind, role, text: F.struct(step(k).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, text = F.lit(None).cast("string"), F.col("text")
    pieces = F.sequence(F.lit(0), F.floor(F.length("text") / F.lit(delta_chars)).cast("int"))
    streamed = F.transform(pieces, lambda i: event(i + 3, "delta", none, F.substr(text, i * delta_chars + 1, F.lit(delta_chars))))
    answer = F.concat(F.array(event(0, "message", F.col("role"), F.lit("")), event(1, "delta", none, F.upper(F.left(text, F.lit(delta_chars)))), event(2, "regenerate", none, F.lit(""))), streamed)
    sent = F.array(event(0, "message", F.col("role"), F.reverse(text)), event(1, "edit", none, text))
    log = first.select("conv_id", "message", F.explode(F.when(F.col("role") == LEARNER, answer).otherwise(sent)).alias("e"))
    return log.select("conv_id", "message", "e.seq", "e.kind", "e.role", "e.text")


def readback(chats: DataFrame) -> DataFrame:
    """What a formatted conversation says when parsed: the number and digest of its turns and of its learnt text."""
    turns = turns_of(F.col("formatted"))
    learnt = learnt_text(F.col("formatted"), F.col("loss_mask"))
    shown = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
