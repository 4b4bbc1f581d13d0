"""Chat formatting by a finite-state machine over roles (operator 10).

A declarative template says which marks stand around the texts of each role,
which roles may follow each other, and whose texts carry loss. The machine
walks the turns of a conversation in order, checks each step against the
table of transitions, and emits segments: pieces of text with a loss flag
whose concatenation is the formatted conversation.

Control strings inside texts are escaped reversibly: a backslash is doubled,
and one is put behind the first character of every place where a control
string starts, so no text can forge a mark. :func:`read` takes a formatted
conversation apart again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.session import ship_package

SEGMENTS = "array<struct<text:string,loss:boolean,role:string>>"


@dataclass(frozen=True)
class Template:
    """``marks``: role -> (before, after); other roles are written between ``other`` marks with their name."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    #: state -> role -> next state; the state is the role of the last turn, "start" before the first.
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    #: Roles with which a conversation may end.
    ends: tuple[str, ...] = ("user", "assistant")
    #: Roles whose texts carry loss.
    loss: tuple[str, ...] = ("assistant",)

    @cached_property
    def controls(self) -> list[str]:
        found = {x for pair in self.marks.values() for x in pair} | set(self.other)
        if any("\\" in x or len(x) < 2 for x in found):
            raise ValueError("control strings need two characters and no backslash")
        return sorted(found, key=lambda x: (-len(x), x))

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(r"\\|(?=" + "|".join(map(re.escape, self.controls)) + r").", re.S)

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))

    def escape(self, text: str) -> str:
        return self._escaped.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool, str]]:
        """(text, loss, role) pieces; marks never carry loss."""
        out = []
        for role, text in turns:
            if role in self.marks:
                before, after = self.marks[role]
            else:
                before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
            out += [(before, False, role), (self.escape(text), role in self.loss, role), (after, False, role)]
        return out

    def check(self, roles: list[str]) -> int:
        """Index of the first turn out of order, the number of turns if the end is wrong, -1 if all is well."""
        state = "start"
        for i, role in enumerate(roles):
            if role not in self.steps.get(state, ()):
                return i
            state = role
        return -1 if state in self.ends else len(roles)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a formatted conversation."""
        opens = {before: (role, after) for role, (before, after) in self.marks.items()}
        turns, at = [], 0
        while at < len(formatted):
            m = self._control.match(formatted, at)
            if m is None:
                raise ValueError(f"no mark at {at}")
            if m[0] in opens:
                role, after = opens[m[0]]
            elif m[0] == self.other[0]:
                name = self._control.search(formatted, m.end())
                if name is None or name[0] != self.other[1]:
                    raise ValueError(f"no role at {m.end()}")
                role, after, m = self.unescape(formatted[m.end() : name.start()]), self.other[2], name
            else:
                raise ValueError(f"unexpected {m[0]} at {at}")
            end = self._control.search(formatted, m.end())
            if end is None or end[0] != after:
                raise ValueError(f"no end of the turn at {at}")
            turns.append((role, self.unescape(formatted[m.end() : end.start()])))
            at = end.end()
        return turns


def format_chats(
    rows: DataFrame, template: Template | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: the id, formatted, segments (text, loss, role), first_error.

    Turns stand in the order of the turn column (nulls first), equal turns in
    the order of role and text, so repeated rows stay and stand side by side.
    Null roles and texts count as empty; a null id is a conversation of its own.
    ``first_error`` is -1 for a conversation in order, else the place of the
    first turn that may not follow (the number of turns if only the end is
    wrong); such conversations are formatted as well. Other columns are not
    read. No rows give no conversations. The result holds a whole conversation
    in one row, as its contract asks.
    """
    ship_package(rows.sparkSession)
    template = template or Template()
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chats = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # as text: a column of numbers with a null among them would become doubles in pandas
    chats = chats.select(F.col("conv").cast("string").alias("conv"), F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [template.segments(list(zip(r, t, strict=True))) for r, t in zip(f["roles"], f["texts"], strict=True)]
            yield pd.DataFrame({
                "conv": f["conv"],
                "formatted": ["".join(s for s, _, _ in x) for x in found],
                "segments": [[{"text": s, "loss": on, "role": r} for s, on, r in x] for x in found],
                "first_error": [template.check(list(r)) for r in f["roles"]],
            })

    kind = rows.schema[conv_col].dataType.simpleString()
    out = chats.mapInPandas(emit, f"conv string, formatted string, segments {SEGMENTS}, first_error int")
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv_col)


def read_back(chats: DataFrame, template: Template | None = None, conv_col: str = "conv_id", *keep: str) -> DataFrame:
    """(id, turns array<struct<role, text>>, loss_text, and the columns to keep): what a formatted table says, unescaped."""
    ship_package(chats.sparkSession)
    template = template or Template()

    @F.pandas_udf("array<struct<role:string,text:string>>")
    def turns(formatted: pd.Series) -> pd.Series:
        return pd.Series([[{"role": r, "text": t} for r, t in template.read(x)] for x in formatted])

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(template.unescape)

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return chats.select(conv_col, turns("formatted").alias("turns"), plain(loss).alias("loss_text"), *keep)


def digests(chats: DataFrame, template: Template | None = None, conv_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, first_error) of the output of :func:`format_chats`, read back."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    both = read_back(chats, template, conv_col, "formatted", "first_error")
    return both.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "first_error",
    )
