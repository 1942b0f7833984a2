"""Chat formatting from an event log.

A log holds, per conversation, events in order of ``seq``: ``message`` starts a message with its text, ``delta`` appends
to it, ``edit`` replaces its text, ``regenerate`` discards it and every message at a later turn, after which further
events build anew. Folding keeps the events that no later edit or regeneration outdates and joins their
texts; rendering writes each message as one turn, with control strings inside texts escaped so that they can be restored.

Work is split by (conversation, message) and by spans of turns, so one giant conversation does not become
one task; what is put together last is the text of a part, at most ``TURNS_PER_PART`` turns. Only DataFrame functions are used.

An event that arrives again (same message, seq and text, and alike a delta or not) counts once. Events of a null or unknown kind
change no message; ``unknown`` returns them, so that they can be set aside.

Null text or role counts as empty, a null turn or sequence number comes first, a null conversation is one of its own.
Messages with equal turns are ordered by role, text and message id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS_PER_PART = 256
TURN_SPAN = 1024  # turns per first-level group when regenerations are carried to later turns
EVENT_SPAN = 4096  # events of one message joined at a time
LOWEST = -(1 << 63)
KINDS = ("message", "delta", "edit")  # events that carry text


@dataclass(frozen=True)
class Template:
    """A turn is ``begin role middle text end``. The three marks must not hold a backslash."""

    begin: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    # Control strings that must not appear inside texts: an escape is put behind their first character.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)

    def _inside(self) -> str:
        signs = [f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in self.controls]
        return "(" + "|".join([r"\\", *signs]) + ")"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(), r"\\$1")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(\\|)", "$1")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def unknown(events: DataFrame) -> DataFrame:
    """Events that :func:`fold` cannot read."""
    known = F.coalesce(F.col("kind").isin(*KINDS, "regenerate"), F.lit(False))
    return events.filter(~known)


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log (``conv_id, message_id, turn, seq, kind, role, text``).

    Returns ``conv_id, no_conv, turn, message_id, role, text``. A message without a surviving event is gone.
    """

    def number(column: str) -> Column:
        return F.coalesce(F.col(column).cast("long"), F.lit(LOWEST))

    log = events.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("conv_id").isNull().alias("no_conv"),
        "message_id",
        number("turn").alias("turn"),
        number("seq").alias("seq"),
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    conv = ["no_conv", "conv_id"]
    # The last regeneration at or before each turn: first within spans of turns, then over the spans.
    turns = log.groupBy(*conv, "turn").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"))
    turns = turns.withColumn("span", F.expr(f"turn div {TURN_SPAN}"))
    earlier = Window.partitionBy(*conv).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = turns.groupBy(*conv, "span").agg(F.max("redone").alias("redone"))
    spans = spans.select(*conv, "span", F.max("redone").over(earlier).alias("earlier"))
    inside = Window.partitionBy(*conv, "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    reset = turns.join(spans, [*conv, "span"]).select(
        *conv, "turn", F.greatest("earlier", F.max("redone").over(inside)).alias("redone")
    )
    message = [*conv, "turn", "message_id"]
    kept = log.join(reset, [*conv, "turn"]).filter(F.col("redone").isNull() | (F.col("seq") > F.col("redone")))
    edited = kept.groupBy(*message).agg(
        F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("edited"),
        F.min(F.when(F.col("role") != "", F.struct("seq", "role")))["role"].alias("first_role"),
    )
    live = kept.join(edited, message).filter(F.col("edited").isNull() | (F.col("seq") >= F.col("edited")))
    live = live.filter(F.col("kind").isin(*KINDS))
    # Join a message's texts in spans of events first, then the spans.
    piece = F.struct("seq", (F.col("kind") == "delta").alias("later"), "text")
    part = live.groupBy(*message, "first_role", F.expr(f"seq div {EVENT_SPAN}").alias("span")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(piece)), lambda e: e["text"]), "").alias("text")
    )
    whole = part.groupBy(*message, "first_role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda e: e["text"]), "").alias("text")
    )
    return whole.withColumn("role", F.coalesce("first_role", F.lit(""))).drop("first_role")


def render(messages: DataFrame, template: Template = Template(), turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per conversation and span of turns: ``conv_id, part, n_turns, formatted, loss_spans``.

    The parts of a conversation in order are its formatted text. A span (``start``, ``length``, in characters of the
    part) covers the text of one turn that counts for the loss.
    """
    role, text = template.escape(F.col("role")), template.escape(F.col("text"))
    head = F.concat(F.lit(template.begin), role, F.lit(template.middle))
    turn = F.struct(
        "turn",
        "role",
        "text",
        "message_id",
        F.concat(head, text, F.lit(template.end)).alias("written"),
        F.length(head).alias("head"),
        F.length(text).alias("body"),
        F.col("role").isin(*template.loss_roles).alias("loss"),
    )
    spans = F.array().cast("array<struct<start:int,length:int>>")
    parts = messages.groupBy("no_conv", "conv_id", F.expr(f"turn div {turns_per_part}").alias("part")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )

    def step(state: Column, t: Column) -> Column:
        own = F.struct((state["at"] + t["head"]).alias("start"), t["body"].alias("length"))
        size = t["head"] + t["body"] + F.lit(len(template.end))
        more = F.when(t["loss"], F.concat(state["spans"], F.array(own))).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), more.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), spans.alias("spans"))
    return parts.select(
        F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id"),
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda state: state["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns written in a part, as an array of ``role`` and ``text``."""
    written = F.split(formatted, _quoted(template.end), -1)
    written = F.slice(written, F.lit(1), F.size(written) - 1)

    def turn(segment: Column) -> Column:
        inner = F.split(segment, _quoted(template.middle), 2)
        role = F.substring(F.element_at(inner, 1), F.lit(len(template.begin) + 1), F.length(F.element_at(inner, 1)))
        return F.struct(
            template.unescape(role).alias("role"), template.unescape(F.element_at(inner, 2)).alias("text")
        )

    return F.transform(written, turn)


def read_loss(formatted: Column, loss_spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask of a part."""

    def text(span: Column) -> Column:
        return template.unescape(F.substring(formatted, span["start"] + 1, span["length"]))

    return F.array_join(F.transform(loss_spans, text), "")


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the formatted parts alone: turns, characters and digests."""
    turns = F.array_join(
        F.transform(read_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
        "",
    )
    read = parts.select(
        "conv_id",
        F.size(read_turns(F.col("formatted"), template)).cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("n_chars"),
        F.struct("part", turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans"), template).alias("loss")).alias("read"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("n_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("read")).alias("read"),
    )
    loss = F.array_join(F.transform("read", lambda r: r["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("read", lambda r: r["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
