"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over the roles checks the order of turns.  Every turn
gives three segments - marker, text, marker - with a loss flag each; the
formatted conversation is its segments one after the other.  Control strings
inside texts are escaped, so that markers are found only where turns have them,
and unescaped when read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import let

OTHER = "*"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers per role (OTHER: any role not listed, its name in hex and `>>` follow the first marker), the control
    strings, and the roles that may follow each role (an empty one: the start)."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
        OTHER: Turn("<<ROLE ", "\n<</ROLE>>\n"),
    })
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE ", "<</ROLE>>")
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Double every backslash, then put one behind the first character of each control string.

    Doubled ones come in even runs and an added one stands alone, so the two
    are told apart when read back.
    """
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit(""))


def segments(turns: Column, template: Template = DEFAULT) -> Column:
    """Array of (text, loss): three for each turn."""

    def of(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def emit(turn: Column) -> Column:
        body = escape(F.coalesce(turn["text"], F.lit("")), template)
        other = template.turns[OTHER]
        out = F.array(of(F.concat(F.lit(other.before), F.hex(_role(turn)), F.lit(">>")), False), of(body, other.loss), of(F.lit(other.after), False))
        for role, t in template.turns.items():
            if role != OTHER:
                out = F.when(turn["role"] == role, F.array(of(F.lit(t.before), False), of(body, t.loss), of(F.lit(t.after), False))
                             ).otherwise(out)
        return out

    return F.flatten(F.transform(turns, emit))


def first_fault(turns: Column, template: Template = DEFAULT) -> Column:
    """Number (from 0) of the first turn whose role may not follow the one before; null if all may."""
    allowed = F.array(*[F.lit(f"{a}\n{b}") for a, bs in template.follow.items() for b in bs])

    def step(state: Column, turn: Column) -> Column:
        ok = F.array_contains(allowed, F.concat(state["role"], F.lit("\n"), _role(turn)))
        return F.struct(_role(turn).alias("role"), (state["at"] + 1).alias("at"),
                        F.when(state["fault"].isNull() & ~ok, state["at"]).otherwise(state["fault"]).alias("fault"))

    start = F.struct(F.lit("").alias("role"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))
    return F.aggregate(turns, start, step, lambda s: s["fault"])


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments, valid and first_fault of every conversation (rows conv_id, turn, role, text).

    Turns are ordered by turn (null first), then role, then text; repeated rows
    are turns of their own.  A null text is empty, a null role the empty role,
    null conversation ids are one conversation.  Conversations out of order are
    formatted too and marked.  Other columns are not read.  A conversation is
    one row, so it has to fit in one.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text")
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = talks.select("conv_id", segments(F.col("turns"), template).alias("segments"),
                        first_fault(F.col("turns"), template).alias("first_fault"))
    return made.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments",
                       F.col("first_fault").isNull().alias("valid"), "first_fault")


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    fixed = {r: t for r, t in template.turns.items() if r != OTHER}
    other = template.turns[OTHER]
    whole = "|".join(f"{re.escape(t.before)}.*?{re.escape(t.after)}" for t in template.turns.values())

    def inner(turn: Column, before: Column, after: str) -> Column:
        return F.substring(turn, before + 1, F.char_length(turn) - before - len(after))

    def back(turn: Column) -> Column:
        named = F.regexp_extract(turn, f"(?s)^{re.escape(other.before)}(.*?)>>", 1)
        out = F.struct(F.decode(F.unhex(named), "UTF-8").alias("role"),
                       unescape(inner(turn, len(other.before) + F.char_length(named) + 2, other.after)).alias("text"))
        for role, t in fixed.items():
            out = F.when(F.startswith(turn, F.lit(t.before)), F.struct(
                F.lit(role).alias("role"), unescape(inner(turn, F.lit(len(t.before)), t.after)).alias("text"))).otherwise(out)
        return out

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s){whole}"), F.lit(0)), lambda found: F.transform(found, back))


def loss_texts(parts: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"]))
