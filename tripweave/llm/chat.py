"""Conversations rebuilt from event logs and rendered for training.

Events of a conversation are ordered by their sequence and folded per message: a ``message``
event starts a turn, a ``delta`` adds streamed text, an ``edit`` replaces what a turn says and a
``regenerate`` takes the conversation back to a turn, dropping that turn's text and every later
turn said so far. The fold is a matter of windows: an event survives if no later event of its
conversation takes it back.

Rendering marks each turn with control strings and escapes texts so that no control string can
appear inside them: ``<``, ``[`` and the backslash each get a backslash after them. Decoding
drops the character after each of the three. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template: turn start, end of the role, turn end.
START, MIDDLE, END = "<s>[INST] ", " [/INST] ", " </s>"

#: The role whose text is learnt.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    r"""``\`` to ``\\``, ``<`` to ``<\`` and ``[`` to ``[\``: a prefix code, so it can be undone."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` per message from ``(conv_id, seq, kind, turn, role, text)``.

    A null text is empty; a null kind is a ``message``. Ties in ``seq`` are broken by turn, kind,
    role and text. A turn's role is that of its first surviving event that names one. An event
    of an unknown kind adds its text like a delta. A turn without surviving events is gone.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rows = events.select("conv_id", "seq", kind.alias("kind"), "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")]
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    later = Window.partitionBy("conv_id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    back = placed.withColumn("back_to", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
    alive = back.where(F.col("back_to").isNull() | (F.col("turn") < F.col("back_to")))
    within = Window.partitionBy("conv_id", "turn").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    said = alive.withColumn("edited", F.coalesce(F.max(F.col("kind") == "edit").over(within), F.lit(False)))
    pieces = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("edited"), F.lit("")).otherwise(F.col("text")).alias("text"))))
    return said.groupBy("conv_id", "turn").agg(
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)`` from ``(conv_id, turn, role, text)``, one row per conversation.

    ``loss_mask`` holds one span per learnt turn: its place among the turns, the code point where
    its text starts in ``formatted`` and in the turn, and its length there. Null roles and texts
    are empty strings; an empty table gives an empty result; a null conv_id is a conversation.
    """
    role, text = escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = messages.select("conv_id", "turn", (F.coalesce(F.col("role").cast("string"), F.lit("")) == LEARNT).alias("learnt"), F.concat(F.lit(START), role, F.lit(MIDDLE)).alias("head"), text.alias("text"))
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sized = marked.withColumn("size", (F.char_length("head") + F.char_length("text") + len(END)).cast("long")).withColumn("at", F.coalesce(F.sum("size").over(window), F.lit(0).cast("long")))
    turn = F.struct("turn", "at", F.concat("head", "text", F.lit(END)).alias("line"), "learnt", F.char_length("head").alias("skip"), F.char_length("text").alias("length"))
    whole = sized.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct(i.alias("place"), (t["at"] + t["skip"]).alias("start"), t["skip"].alias("skip"), t["length"].alias("length"), t["learnt"].alias("learnt")))
    spans = F.transform(F.filter(numbered, lambda s: s["learnt"]), lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["skip"].alias("skip"), s["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("formatted"), spans.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """``(role, text)`` of every turn, read back from a rendered conversation."""
    lines = F.filter(F.split(formatted, END), lambda x: x != "")
    cut = lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), r" \[/INST\] ", 2)
    return F.transform(F.transform(lines, cut), lambda p: F.struct(unescape(F.get(p, 0)).alias("role"), unescape(F.get(p, 1)).alias("text")))


def learnt(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped text under the loss mask, span after span."""
    lines = F.split(formatted, END)
    texts = lambda lines: F.transform(loss_mask, lambda s: unescape(F.substring(F.get(lines, s["place"]), s["skip"] + 1, s["length"])))
    return F.array_join(F.flatten(F.transform(F.array(lines), texts)), "")


def log_of(rows: DataFrame) -> DataFrame:
    """A log in which every row ``(conv_id, seq, role, text)`` is a finished message.

    Rows of equal ``seq`` are turns of their own, in order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    place = F.row_number().over(order).cast("long")
    return rows.select("conv_id", place.alias("seq"), F.lit("message").alias("kind"), place.alias("turn"), "role", "text")
