"""Chat formatting from a declarative template, in column expressions only.

A finite-state machine over roles checks the turn order; its state is the role
last seen.  Each turn becomes segments -- marks and escaped text -- with a loss
flag.  The formatted text can be read back without loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ESCAPE = "\\"
START = "start"
BLOCK = 256  # turns looked at together


@dataclass(frozen=True)
class Turn:
    """Marks around a role's text, and whether the text counts for the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """``turns`` by role; any other role is written between the marks of
    ``other``, its name before ``other_text``.  ``follows`` lists the roles that
    may come in each state, ``ends`` the states a conversation may end in."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    })
    other: Turn = Turn("[ROLE]", "[/ROLE]")
    other_text: str = "[TEXT]"
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.controls()
        heads = {m[:1] for m in marks}
        if "" in heads or ESCAPE in "".join(marks) or any(h in m[1:] for m in marks for h in heads):
            raise ValueError("marks must not be empty, hold the escape character or another mark's first character")
        opens = [t.open for t in (*self.turns.values(), self.other)]
        if len(set(opens)) < len(opens):
            raise ValueError("every role needs an opening mark of its own")

    def controls(self) -> list[str]:
        turns = (*self.turns.values(), self.other)
        return sorted({m for t in turns for m in (t.open, t.close)} | {self.other_text})


def _any_of(marks: list[str]) -> str:
    return "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))


def escape(text: Column, template: ChatTemplate) -> Column:
    """Escape characters are doubled, and one is put behind the first character
    of every mark, so no mark is left in the text."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, rf"(?s)(?={_any_of(template.controls())})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _allowed(state: Column, role: Column, template: ChatTemplate) -> Column:
    out = F.lit(False)
    for name, roles in template.follows.items():
        out = F.when(state == name, role.isin(*roles)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def segments(template: ChatTemplate) -> Column:
    """Segments of a turn from its columns ``role`` and ``text``."""

    def piece(text: Column, loss: bool = False) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")), template)
    out = F.array(piece(F.lit(template.other.open)), piece(escape(role, template)),
                  piece(F.lit(template.other_text)), piece(text, template.other.loss),
                  piece(F.lit(template.other.close)))
    for name, turn in template.turns.items():
        own = F.array(piece(F.lit(turn.open)), piece(text, turn.loss), piece(F.lit(turn.close)))
        out = F.when(role == name, own).otherwise(out)
    return out


def turn_segments(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, state, allowed, last, segments.

    ``state`` is the role of the turn before, ``start`` at the beginning;
    ``allowed`` says whether the role may follow it.  Turns are in order of
    their number (nulls first), then role, then text, so ties and repeated rows
    have a place; a null conversation id is a conversation of its own.

    The state only needs the row before.  Conversations are looked at in blocks
    of turn numbers; a block learns the state it begins with from a table with
    one row per block, so a very long conversation is not one task's work.
    """
    template = template or ChatTemplate()
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({
        "id": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull(),
        "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("bigint")})
    keys = ["id", "none", "block"]
    inside = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "before": F.lag(F.coalesce("role", F.lit(""))).over(inside),
        "is_last": F.lead(F.lit(True)).over(inside).isNull()})
    ends = rows.where("is_last").select(*keys, F.coalesce("role", F.lit("")).alias("ends_in"))
    across = Window.partitionBy("id", "none").orderBy("block")
    ends = ends.select(
        *keys, F.coalesce(F.lag("ends_in").over(across), F.lit(START)).alias("begins_in"),
        F.lead(F.lit(True)).over(across).isNull().alias("last_block"))
    state = F.coalesce("before", "begins_in")
    return rows.join(ends, keys).select(
        "conv_id", "turn", "role", "text", state.alias("state"),
        _allowed(state, F.col("role"), template).alias("allowed"),
        (F.col("is_last") & F.col("last_block")).alias("last"), segments(template).alias("segments"))


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss),
    n_rows, valid, first_error (turn number).

    ``valid``: every role may follow the one before and the last state is one to
    end in.  All conversations are formatted, valid or not; a null text is
    empty, a role without marks of its own is written by name.
    """
    template = template or ChatTemplate()
    turn = F.struct("turn", "role", "text", "segments")
    wrong = ~F.col("allowed")
    whole = turn_segments(turns, template).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.count("*").alias("n_rows"),
        F.min(F.when(wrong, F.col("turn"))).alias("first_error"),
        F.max(wrong).alias("has_error"),
        F.max(F.when(F.col("last"), F.col("role"))).alias("end"))
    parts = F.flatten(F.transform("turns", lambda t: t["segments"]))
    return whole.select(
        "conv_id", parts.alias("segments"), "n_rows",
        (~F.col("has_error") & F.coalesce(F.col("end").isin(*template.ends), F.lit(False))).alias("valid"),
        "first_error",
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) of a formatted conversation.  A null role comes
    back as an empty one."""
    template = template or ChatTemplate()
    every = {**template.turns, None: template.other}
    opens = _any_of([t.open for t in every.values()])

    def inner(piece: Column, turn: Turn) -> Column:
        return F.substr(piece, F.lit(len(turn.open) + 1), F.length(piece) - len(turn.open) - len(turn.close))

    def turn_of(piece: Column) -> Column:
        body = inner(piece, template.other)
        named = F.split(body, re.escape(template.other_text), 2)
        out = F.struct(unescape(named[0]).alias("role"), unescape(F.coalesce(F.get(named, F.lit(1)), F.lit(""))).alias("text"))
        for name, turn in template.turns.items():
            own = F.struct(F.lit(name).alias("role"), unescape(inner(piece, turn)).alias("text"))
            out = F.when(F.startswith(piece, F.lit(turn.open)), own).otherwise(out)
        return out

    pieces = F.filter(F.split(formatted, f"(?={opens})"), lambda p: F.length(p) > 0)
    return F.transform(pieces, turn_of)


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, as it was."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
