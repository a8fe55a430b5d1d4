"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame operations.

A turn becomes segments, each with a loss flag: a head (opening mark, role, closing mark), the
text, and a tail. Control strings inside roles and texts get one backslash after their first
character, after which no control string is left in them; where backslashes stand there already,
they get one more. Taking one away again restores the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """`open`, `close`, `end`: marks around the role and after the text. `loss`: roles whose texts are trained on. `next`: by role, the roles that may follow; '' is the start. `final`: roles that may come last."""

    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)
    next: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        marks = (self.open, self.close, self.end)
        if any(len(m) < 2 or "\\" in m for m in marks) or any(a != b and a in b for a in marks for b in marks) or any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(1, len(a))):
            raise ValueError("marks need two characters or more, no backslash, and must not overlap")
        return marks


def escape(text: Column, template: Template) -> Column:
    for m in template.controls():
        text = F.regexp_replace(text, re.escape(m[0]) + r"(\\*)" + re.escape(m[1:]), f"{_literal(m[0])}\\\\$1{_literal(m[1:])}")
    return text


def unescape(text: Column, template: Template) -> Column:
    for m in template.controls():
        text = F.regexp_replace(text, re.escape(m[0]) + r"\\(\\*)" + re.escape(m[1:]), f"{_literal(m[0])}$1{_literal(m[1:])}")
    return text


def _literal(s: str) -> str:
    return s.replace("$", r"\$")


def format_chats(chats: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, segments (array of text and loss), formatted, valid, first_error (the turn's place from 0, or n_turns for a bad end; null if valid).

    Turns are ordered by turn, then role, then text, null turns first; equal rows count as turns of
    their own. Null texts and roles count as empty; a null conv_id is a conversation. An order that
    the machine rejects is reported in `valid`, never dropped. Turns are formatted where they are
    read; one shuffle brings a conversation's segments together, as its result is one text. An empty table gives no rows.
    """
    q = lambda c: F.col(f"`{c}`")
    said = F.coalesce(q(role), F.lit(""))
    rows = chats.select(
        q(conv_id).alias("conv_id"),
        F.struct(
            q(turn).alias("turn"),
            said.alias("role"),
            F.coalesce(q(text), F.lit("")).alias("text"),
            F.concat(F.lit(template.open), escape(said, template), F.lit(template.close)).alias("head"),
            escape(F.coalesce(q(text), F.lit("")), template).alias("body"),
            said.isin(*template.loss).alias("loss"),
        ).alias("t"),
    )
    chat = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    segments = F.flatten(F.transform("ts", lambda t: F.array(F.struct(t["head"].alias("text"), F.lit(False).alias("loss")), F.struct(t["body"].alias("text"), t["loss"].alias("loss")), F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))))
    roles = F.transform("ts", lambda t: t["role"])
    steps = F.array(*[F.lit(f"{a}>{b}") for a, follow in template.next.items() for b in follow])
    machine = F.aggregate(
        roles,
        F.struct(F.lit("").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("error")),
        lambda acc, r: F.struct(r.alias("state"), (acc["i"] + 1).alias("i"), F.coalesce(acc["error"], F.when(~F.array_contains(steps, F.concat(acc["state"], F.lit(">"), r)), acc["i"])).alias("error")),
        lambda acc: F.coalesce(acc["error"], F.when(~acc["state"].isin(*template.final), acc["i"])),
    )
    return chat.select("conv_id", F.size("ts").cast("long").alias("n_turns"), segments.alias("segments"), machine.alias("first_error")).select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("first_error").isNull().alias("valid"), "first_error")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    parts = F.split(formatted, re.escape(template.end), -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def parsed(t: Column) -> Column:
        marks = F.split(F.substr(t, F.lit(len(template.open) + 1)), re.escape(template.close), 2)
        return F.struct(unescape(F.get(marks, 0), template).alias("role"), unescape(F.get(marks, 1), template).alias("text"))

    return F.transform(turns, parsed)
