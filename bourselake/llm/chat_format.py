"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events of conversations. Partitioned by conversation and ordered by sequence, they fold into final messages:
deltas append to a message, an edit replaces its text, a regeneration replaces it and discards what followed. The messages
are rendered with a template that marks turns, and control strings inside texts are escaped so that they can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

#: The template's control strings: start of a conversation, open and close of a turn that is not learned, and of one that is.
BEGIN, OPEN, CLOSE, OPEN_LEARNED, CLOSE_LEARNED = "<s>", "[INST]", "[/INST]", "[OUT]", "</s>"

#: Roles whose text is under the loss mask.
LEARNED_ROLES = ("assistant",)

_HEAD, _REST = r"([<\[])", r"(/?s>|/?INST\]|OUT\])"


def escaped(text: Column) -> Column:
    """A control string gets a backslash after its first sign, and one that has backslashes there already gets one more."""
    return F.regexp_replace(text, _HEAD + r"(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"\\(\\*)" + _REST, r"$1$2$3")


def _escaped_role(role: Column) -> Column:
    """A role is on one line: backslashes and line ends are written as two signs."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the final messages of a log (conv_id, seq, kind, message, role, text).

    Events of a conversation are ordered by seq, and equal ones by kind and text. ``message`` names the message an event belongs
    to; where it is null the event is a message of its own. A message, an edit and a regeneration set the text, deltas after
    it append; a delta without one starts from an empty text. A regeneration also discards the messages that began
    before it and after its own message began. The first role that is not null is the message's. Null text is empty,
    null kind is a message.
    """
    log = events.select("conv_id", "seq", F.coalesce("kind", F.lit(MESSAGE)).alias("kind"), F.col("message").cast("string").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("seq", "kind", "message", "role", "text")
    log = log.withColumn("at", F.row_number().over(ordered))
    log = log.withColumn("message", F.coalesce(F.concat(F.lit("m"), "message"), F.concat(F.lit("n"), F.col("at").cast("string"))))
    within = Window.partitionBy("conv_id", "message").orderBy("at")
    log = log.withColumn("sets", F.sum(F.when(F.col("kind") != DELTA, 1).otherwise(0)).over(within))
    log = log.withColumn("last_set", F.max("sets").over(Window.partitionBy("conv_id", "message")))
    part = F.when(F.col("sets") == F.col("last_set"), F.struct("at", "text"))
    messages = log.groupBy("conv_id", "message").agg(
        F.min("at").alias("position"),
        F.max(F.when(F.col("kind") == REGENERATE, F.col("at"))).alias("regenerated"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).alias("role"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("discarded_to", F.max("regenerated").over(before))
    alive = F.coalesce(F.col("position") > F.col("discarded_to"), F.lit(True))
    return messages.filter(alive).select("conv_id", "position", F.coalesce("role.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one string, and [from, to) in code points of what is learned.

    A conversation is one row of the result and so is gathered in one task; that is the unit of work and of memory.
    """
    learned = F.coalesce(F.col("role").isin(*LEARNED_ROLES), F.lit(False))
    head = F.concat(F.when(learned, OPEN_LEARNED).otherwise(OPEN), _escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", "position", head.alias("head"), body.alias("body"), F.when(learned, CLOSE_LEARNED).otherwise(CLOSE).alias("tail"), learned.alias("learned"))
    turns = turns.withColumn("length", F.length("head") + F.length("body") + F.length("tail"))
    earlier = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("from", F.coalesce(F.sum("length").over(earlier), F.lit(0)) + len(BEGIN) + F.length("head"))
    span = F.when(F.col("learned"), F.struct("position", "from", (F.col("from") + F.length("body")).alias("to")))
    turn = F.struct("position", F.concat("head", "body", "tail").alias("turn"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_list(span)).alias("spans"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["turn"]), ""))
    return chats.select("conv_id", formatted.alias("formatted"), F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))).alias("loss_spans"))


_TURN = r"(?s)(\[INST\]|\[OUT\])([^\n]*)\n(.*?)(?:\[/INST\]|</s>)"


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text, learned)."""
    parts = [F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(
        F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("mark", "role", "text"), strict=True))),
        lambda t: F.struct(_unescaped_role(t["role"]).alias("role"), unescaped(t["text"]).alias("text"), (t["mark"] == OPEN_LEARNED).alias("learned")),
    )
