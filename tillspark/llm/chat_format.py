"""Chat formatting: a declarative template, an escape that can be undone, and a finite-state machine over roles.

Native: every step is a DataFrame function; there is no Python on the executors.

A conversation becomes an array of text segments, each with a loss flag. The
trainer's input is the concatenation of the segments; tokens of segments whose
flag is true count in the loss. Control strings of the template that occur in a
text are escaped, so the concatenation can be read back without ambiguity.

Edge cases: a null text is empty; a null role is the empty role; rows of one
conversation are ordered by turn, ties by role and text, null turns first;
repeated rows are turns of their own; rows with a null conversation id form one
conversation; an empty table gives an empty result; other columns are ignored.
An invalid turn order does not drop a conversation: ``valid`` is false and
``bad_turn`` is the index of the first turn that the machine refuses.

One conversation is one training sample and so one row; its segments must fit a
row. Conversations are spread by id, texts are neither cut nor sampled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BAD = "start", "bad"


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around each turn, which roles bear loss and which role may follow which."""

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>"
    turn_gap: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; a turn without an entry is refused.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "system",
            (START, "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn_open, self.turn_close)

    def __post_init__(self):
        if any(not c or c[0] in "\\eln\n" or "\\" in c for c in self.controls) or self.role_end != "\n":
            raise ValueError("a control string must start with a character other than a backslash, e, l, n or a line end; roles end with a line end")
        if len({c[0] for c in self.controls}) != 1:
            raise ValueError("the control strings must start with the same character")


DEFAULT_TEMPLATE = ChatTemplate()


def escaped(text: Column, template: ChatTemplate, role: bool = False) -> Column:
    """Backslash -> ``\\e``; the first character of a control string -> ``\\l``; in a role, a line end -> ``\\n``.

    Every backslash of the result starts one of these pairs, so ``unescaped`` restores the text exactly.
    """
    first = template.turn_open[0]
    rests = "|".join(re.escape(c[1:]) for c in sorted(template.controls, key=len, reverse=True))
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, f"{re.escape(first)}(?={rests})", r"\\l")
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column, template: ChatTemplate, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit(template.turn_open[0]))
    out = F.replace(out, F.lit("\\n"), F.lit("\n")) if role else out
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _accepted(turns: Column, template: ChatTemplate) -> Column:
    """Index of the first refused turn, or null: a fold of the machine over the roles."""
    cells = [x for (state, role), to in template.transitions.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    machine = F.create_map(*cells)
    zero = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(machine, F.concat(acc["state"], F.lit("\n"), turn["role"])), F.lit(BAD))
        on = (acc["state"] != BAD) & (to != BAD)
        return F.struct(F.when(on, to).otherwise(F.lit(BAD)).alias("state"), (acc["at"] + F.when(on, 1).otherwise(0)).alias("at"))

    return F.aggregate(turns, zero, step, lambda acc: F.when(acc["state"] == BAD, acc["at"]))


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = DEFAULT_TEMPLATE,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments array<struct<text, loss>>, valid, bad_turn."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text")).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        opened = F.concat(F.lit(template.turn_open), escaped(t["role"], template, role=True), F.lit(template.role_end))
        return F.array(
            segment(opened, F.lit(False)),
            segment(escaped(t["text"], template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.turn_close + template.turn_gap), F.lit(False)),
        )

    bad = _accepted(F.col("turns"), template)
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
        bad.isNull().alias("valid"),
        bad.alias("bad_turn"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted_text: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation."""
    parts = F.split(formatted_text, re.escape(template.turn_close + template.turn_gap))
    pieces = F.slice(parts, 1, F.size(parts) - 1)

    def of_piece(p: Column) -> Column:
        body = F.substring(p, len(template.turn_open) + 1, 2147483647)
        name = F.substring_index(body, template.role_end, 1)
        words = F.substr(body, F.char_length(name) + F.lit(1 + len(template.role_end)))
        return F.struct(unescaped(name, template, role=True).alias("role"), unescaped(words, template).alias("text"))

    return F.transform(pieces, of_piece)


def loss_text(segments: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def digests(chats: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """What the registered query returns, read back from the formatted output."""
    text = chats.select("conv_id", "valid", "bad_turn", formatted(F.col("segments")).alias("formatted"), loss_text(F.col("segments"), template).alias("loss"))
    back = text.withColumn("back", read_back(F.col("formatted"), template))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
