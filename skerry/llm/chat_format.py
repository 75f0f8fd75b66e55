"""Operator 9, chat formatting, in DataFrame expressions only.

A declarative :class:`ChatTemplate` names the roles, the allowed role changes
and the strings around a turn.  A finite-state machine reads the roles of each
conversation; its states are the roles (and ``start``), so the state after a
turn is known from that turn, an arc from the two, and a conversation of any
length is walked in linear time.  The states validate turn order, and they say
which of a turn's three text segments (opening, text, closing) bear loss.  The
training text of a conversation is its segments joined, nothing else.

Escaping.  Inside texts ``\\`` becomes ``\\\\`` and ``<`` becomes ``\\l``; in
role names ``>`` becomes ``\\g`` as well.
No ``<`` is left in an escaped text, so a control string can only come from
the template, and the two replacements are undone exactly.

Defined results.  Null text is the empty text; a null role is the role "".
Turns with the same number are taken in (turn, role, text) order, null turn
numbers first.  Rows with a null conv_id form one conversation.  A
conversation whose roles leave the machine is formatted all the same and has
``valid`` false with the index of the first bad turn in ``bad_turn``.  Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Strings around a turn (``{role}`` is replaced), loss roles, and the machine's arcs."""

    opening: str = "<turn {role}>\n"
    closing: str = "\n</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    arcs: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not self.opening.startswith("<") or self.opening.count("{role}") != 1 or "<" not in self.closing:
            raise ValueError("opening must start with '<' and name {role} once; closing must hold a '<'")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes split the text exactly at escaped backslashes, since every escape has two characters."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, n_turns, valid, bad_turn, segments array<struct<text,loss>>, formatted.

    One shuffle on conv_id; a conversation is the unit of training text, so its
    turns meet in one task by definition.
    """
    t = template or ChatTemplate()
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head, tail = t.opening.split("{role}")

    arcs = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, tos in t.arcs.items() for b in tos])

    def step(row: Column, i: Column) -> Column:
        """The state after a turn, and whether the machine has the arc that leads there."""
        before = F.when(i == 0, F.lit(t.start)).otherwise(F.get("rows", i - 1)["role"])
        return F.struct(row["role"].alias("state"), F.array_contains(arcs, F.struct(before.alias("from"), row["role"].alias("to"))).alias("ok"), row["text"].alias("text"))

    def segments(turn: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(head), F.replace(escape(turn["state"]), F.lit(">"), F.lit("\\g")), F.lit(tail)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), turn["state"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")),
        )

    walked = grouped.select("conv_id", F.transform("rows", step).alias("turns"))
    bad = F.array_position(F.transform("turns", lambda x: x["ok"]), False).cast("int")
    return walked.select("conv_id", "turns", F.flatten(F.transform("turns", segments)).alias("segments")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        ((bad == 0) & F.element_at("turns", -1)["state"].isin(*t.final)).alias("valid"),
        F.when(bad > 0, bad - 1).alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Recover the turns and the text under the loss mask from the joined text; the segments give the mask only.

    Returns conv_id, valid, turns array<struct<role,text>>, loss_text, formatted_chars.
    """
    t = template or ChatTemplate()
    head, tail = t.opening.split("{role}")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(head) + 1), F.length(piece))
        cut = F.locate(tail, body)
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(tail), F.length(body))).alias("text"),
        )

    pieces = F.split(F.col("formatted"), "\\Q" + t.closing + "\\E", -1)
    read = formatted.select("conv_id", "valid", "segments", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"))
    lost = F.transform("turns", lambda x, i: F.when(F.get("segments", 3 * i + 1)["loss"], x["text"]).otherwise(""))
    return read.select("conv_id", "valid", "turns", F.array_join(lost, "").alias("loss_text"), "formatted_chars")
