"""Chat formatting in DataFrame operations alone.

A finite-state machine over roles reads each conversation turn by turn; its state after a turn is decided by the
turn's role, so the state in front of a turn is the lagged role's. A declarative template gives each role its opening
and closing strings and says whether its text counts towards the loss. Control strings inside texts are broken by an
escape that can be undone, so the formatted text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "start"
OTHER = "other"


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`roles`: how a role's turns look; any other role is named between `named` and its text. `moves`: the roles that
    may follow a state. `ends`: the states in which a conversation may end."""

    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", True)})
    other: Turn = field(default_factory=lambda: Turn("[ROLE]", "[/ROLE]"))
    named: str = "[TEXT]"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        parts = [s.strip() for t in (*self.roles.values(), self.other) for s in (t.opening, t.closing)] + [self.named]
        return sorted(set(parts), key=lambda s: (-len(s), s))


def escape(text: Column, template: Template) -> Column:
    """Double backslashes, and put a backslash and an exclamation mark behind a control string's first character."""
    inside = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), inside, r"\\!")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:!|(\\))", "$1")


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each turn and each part of it: conv_id, nth (turn's place), part, segment, loss, valid.

    Parts are 0 (opening), 1 (text, escaped) and 2 (closing); loss is true for part 1 of roles that count. `valid`: the
    turn's role may follow. Turns are ordered by turn, then role, then text, nulls first; null roles and texts count as
    empty; rows with a null conv_id are one conversation; equal rows are turns of their own.
    """
    template = template or Template()
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    state = F.coalesce(F.lag("role").over(order), F.lit(START))
    known = {r: (t.opening, t.closing, t.loss) for r, t in template.roles.items()}
    allowed = F.lit(False)
    for s, roles in template.moves.items():
        allowed |= (F.col("_state") == s) & F.col("role").isin(*roles)

    def by_role(pick: int, otherwise: Column) -> Column:
        out = otherwise
        for role, parts in known.items():
            out = F.when(F.col("role") == role, F.lit(parts[pick])).otherwise(out)
        return out

    named = F.concat(F.lit(template.other.opening), escape(F.col("role"), template), F.lit(template.named))
    placed = turns.select("*", state.alias("_state"), F.row_number().over(order).cast("long").alias("nth"))
    row = placed.select("conv_id", "nth", "role", allowed.alias("valid"), by_role(0, named).alias("_open"), escape(F.col("text"), template).alias("_text"), by_role(1, F.lit(template.other.closing)).alias("_close"), by_role(2, F.lit(template.other.loss)).alias("_loss"))
    part = lambda n, c, loss: F.struct(F.lit(n).alias("part"), F.col(c).alias("segment"), loss.alias("loss"))
    return row.select("conv_id", "nth", "role", "valid", F.inline(F.array(part(0, "_open", F.lit(False)), part(1, "_text", F.col("_loss")), part(2, "_close", F.lit(False)))))


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_segments, formatted (the text), segments (array of segment and loss, in order) and valid.

    The result is a value for each conversation, so one conversation's turns meet in one row; nothing else does.
    """
    template = template or Template()
    rows = segments(conversations, template)
    piece = F.struct("nth", "part", "segment", "loss", "role", "valid")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("_s"))
    valid = F.forall("_s", lambda s: s["valid"]) & F.element_at("_s", -1)["role"].isin(*template.ends)
    return held.select("conv_id", F.transform("_s", lambda s: F.struct(s["segment"].alias("segment"), s["loss"].alias("loss"))).alias("segments"), valid.alias("valid")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["segment"]), ""))


def read_back(text: Column, template: Template | None = None) -> Column:
    """Array of (role, text) that a formatted text holds."""
    template = template or Template()
    q = lambda s: r"\Q" + s + r"\E"
    forms = [f"{q(t.opening)}(.*?){q(t.closing)}" for t in template.roles.values()]
    any_turn = "(?s)" + "|".join([*(f.replace("(", "(?:") for f in forms), f"{q(template.other.opening)}.*?{q(template.named)}.*?{q(template.other.closing)}"])

    def parse(turn: Column) -> Column:
        split = F.split(F.substr(turn, F.lit(len(template.other.opening) + 1), F.length(turn) - len(template.other.opening + template.other.closing)), q(template.named), 2)
        out = F.struct(unescape(split[0]).alias("role"), unescape(split[1]).alias("text"))
        for role, t in template.roles.items():
            body = F.substr(turn, F.lit(len(t.opening) + 1), F.length(turn) - len(t.opening + t.closing))
            out = F.when(F.startswith(turn, F.lit(t.opening)), F.struct(F.lit(role).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(any_turn), F.lit(0)), parse)
