"""Filters said as data, and what a question's wording asks for."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question, in the order they are tried.
ACTION_WORDS = ("action", "todo", "to-do", "need to", "should", "must", "pending", "waiting")
FOLLOWUP_WORDS = ("i sent", "my sent", "haven't heard", "no response", "waiting for reply", "follow up")


def compile_filter(where: Mapping | None) -> Column:
    """A predicate of {field: value}, {field: {"$gte" | "$lte" | "$lt" | "$eq": value}} and {"$and": [...]}, which hides its siblings. A missing field counts as an empty string."""
    if not where:
        return F.lit(True)
    if "$and" in where:
        parts = [compile_filter(w) for w in where["$and"]]
    else:
        parts = []
        for name, want in where.items():
            for op, value in (want if isinstance(want, Mapping) else {"$eq": want}).items():
                c = F.col(name) if not isinstance(value, str) else F.coalesce(F.col(name).cast("string"), F.lit(""))
                parts.append({"$gte": c >= value, "$lte": c <= value, "$lt": c < value, "$eq": F.coalesce(c == value, F.lit(False))}.get(op))
                if parts[-1] is None:
                    raise ValueError(f"unknown operator {op}")
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


# The forms of a span of time, in the order they are tried, are those of time_range().
DAYS = r"(?:past|last)\s+(\d+)\s+days?"


def time_range(question: str, now: datetime) -> tuple[datetime, datetime] | None:
    """The half-open days a question names, the first of the known forms in it."""
    q, day = question.lower(), now.replace(hour=0, minute=0, second=0, microsecond=0)
    monday = day - timedelta(days=day.weekday())
    if "today" in q:
        return day, day + timedelta(days=1)
    if "yesterday" in q:
        return day - timedelta(days=1), day
    if "this week" in q:
        return monday, now
    if "last week" in q:
        return monday - timedelta(days=7), monday
    if m := re.search(DAYS, q):
        return now - timedelta(days=int(m[1])), now
    return None


def question_type(question: Column) -> Column:
    q = F.lower(question)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    return F.when(has(ACTION_WORDS), "action_needed").when(has(FOLLOWUP_WORDS), "sent_followup").when(F.contains(q, F.lit("unread")), "unread").otherwise("general")


def kind_of(question: str) -> str:
    """question_type() of one string."""
    q = question.lower()
    return "action_needed" if any(w in q for w in ACTION_WORDS) else "sent_followup" if any(w in q for w in FOLLOWUP_WORDS) else "unread" if "unread" in q else "general"


def question_filter(kind: str) -> dict:
    return {"action_needed": {"direction": "received", "is_replied": False}, "sent_followup": {"direction": "sent", "is_replied": False}, "unread": {"is_read": False, "direction": "received"}}.get(kind, {})


def build_where(equal: Mapping, span: tuple[datetime, datetime] | None) -> dict:
    """The parts that a question asks for, as one filter; the span's end is outside."""
    parts = [{k: v} for k, v in equal.items()]
    if span:
        parts += [{"date": {"$gte": span[0].isoformat(sep=" ")}}, {"date": {"$lt": span[1].isoformat(sep=" ")}}]
    return {} if not parts else parts[0] if len(parts) == 1 else {"$and": parts}
