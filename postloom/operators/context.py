"""What a prompt holds: numbered messages by thread, rendered and shortened."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(messages: DataFrame) -> DataFrame:
    """Adds `ref` from 1: threads in the order of their first hit, messages by date, then messages without a thread. Made for the hits of one question: rows are tens, and one task numbers them."""
    alone = F.coalesce("conversation_id", F.lit("")) == ""
    first = messages.where(~alone).groupBy("conversation_id").agg(F.min("hit_rank").alias("thread_rank"))
    rows = messages.join(first, "conversation_id", "left")
    order = Window.orderBy(alone, F.when(alone, F.col("hit_rank")).otherwise(F.col("thread_rank")), F.coalesce(F.col("date").cast("string"), F.lit("")), "message_id")
    return rows.withColumn("ref", F.row_number().over(order).cast("long")).drop("thread_rank")


def render(most: int = 2500) -> Column:
    """A message as a prompt shows it, with the first `most` characters of its body."""
    # The labels.
    content = F.regexp_replace("body", r"^\s+|\s+$", "")
    yes = lambda c, a, b: F.when(F.col(c), a).otherwise(b)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Direction: "), F.when(F.col("direction") == "sent", "SENT BY ME").otherwise("RECEIVED")),
        F.concat(F.lit("From: "), F.coalesce(F.nullif("sender_name", F.lit("")), "sender")),
        F.concat(F.lit("Subject: "), "subject"),
        F.concat(F.lit("Date: "), F.date_format("date", "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("Status: "), yes("is_read", "Read", "UNREAD"), F.lit(" | Replied: "), yes("is_replied", "Yes", "NO - NOT REPLIED")),
        F.lit("\nCONTENT:"),
        F.substring(content, 1, most),
        F.when(F.length(content) > most, "[...truncated...]"),
    )


def within(hits: DataFrame, budget: tuple[int, int], rank: str = "hit_rank") -> tuple[DataFrame, int]:
    """The hits that a model's budget (messages, characters of each; see Config.budget) takes, best first, and the characters."""
    most, chars = budget
    return hits.where(F.col(rank) <= most), chars


def assembled(numbered_messages: DataFrame, most: int = 2500) -> DataFrame:
    """One row: the messages' texts under their reference numbers."""
    rows = numbered_messages.select("ref", F.concat(F.lit("--- Message [SRC-"), F.col("ref").cast("string"), F.lit("]\n"), render(most)).alias("text"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref", "text"))), lambda r: r["text"]), "\n\n").alias("context"), F.count("*").alias("n"))


def reference_map(numbered_messages: DataFrame) -> DataFrame:
    return numbered_messages.select(F.concat(F.lit("SRC-"), F.col("ref").cast("string")).alias("ref_key"), "subject", F.coalesce(F.nullif("sender_name", F.lit("")), "sender").alias("sender"), "date", "message_id")


def cited(answers: DataFrame, references: DataFrame) -> DataFrame:
    """answer_id, ref_key, message_id (null if there is no such reference) of each distinct [SRC-n] in answers."""
    found = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(SRC-\d+)\]"), F.lit(1)))).alias("ref_key"))
    return found.join(references.select("ref_key", "message_id"), "ref_key", "left")


def shrunk(messages: DataFrame, rounds: int = 1) -> DataFrame:
    """Without the oldest third (one at least), `rounds` times; for the rows of one prompt."""
    for _ in range(rounds):
        n = messages.agg(F.greatest(F.floor(F.count("*") / 3), F.lit(1)).alias("cut"))
        order = Window.orderBy(F.coalesce(F.col("date").cast("string"), F.lit("")), "message_id")
        messages = messages.withColumn("age", F.row_number().over(order)).join(F.broadcast(n)).where("age > cut").drop("age", "cut")
    return messages


#: Instructions by kind of prompt, in our own words.
INSTRUCTIONS = {
    "chat": "Answer from the messages only. Name your sources as [SRC-n].",
    "meeting": "Prepare a brief for the meeting described below from the messages only: background, open points, what others may expect. Name your sources as [SRC-n].",
    "research": "Write a report on the topic from the messages only: course of events, people, decisions, what is open. Name your sources as [SRC-n].",
}
#: What a prompt says where there are no messages.
NOTHING = {"chat": "No messages were found. Say so, and suggest to ingest messages first.", "meeting": "No messages were found on this meeting. Say so, and suggest to ask colleagues for background.", "research": "No messages were found on this topic. Say so."}


def prompt(question: str, context: Column, instructions: str) -> Column:
    """Instructions, the messages, and the question, for any model that takes text."""
    return F.concat_ws("\n\n", F.lit(instructions), F.concat(F.lit("MESSAGES\n"), context), F.concat(F.lit("QUESTION\n"), F.lit(question)))


def prompt_of(kind: Column, subject: Column, context: Column, now: Column, details: Column | None = None) -> Column:
    """The prompt of a chat, meeting or research: instructions, time, details (meetings: meeting_details()), messages, and the question, meeting or topic. Without messages it says so instead."""
    by = lambda texts: F.element_at(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))]), kind)
    label = F.when(kind == "meeting", "MEETING").when(kind == "research", "TOPIC").otherwise("QUESTION")
    shown = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("MESSAGES\n"), context)).otherwise(by(NOTHING))
    return F.concat_ws("\n\n", by(INSTRUCTIONS), F.concat(F.lit("NOW "), F.date_format(now, "EEEE, MMMM dd, yyyy HH:mm")), details if details is not None else F.lit(None).cast("string"), shown, F.concat(label, F.lit("\n"), subject))


def meeting_details(start: Column, end: Column, attendees: Column, location: Column, most: int | None = 10) -> Column:
    """When, where and with whom; the first `most` people, or all."""
    who = F.array_join(attendees if most is None else F.slice(attendees, 1, most), ", ")
    known = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise("not given")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return F.concat(F.lit("TIME "), at(start), F.lit(" to "), at(end), F.lit("\nPEOPLE "), known(who), F.lit("\nPLACE "), known(location))


class Overflow(Exception):
    """What a model raises whose context a prompt exceeds."""


#: A prompt is tried once as it is, and so often with fewer messages.
RETRIES = 3


def numbered_text(texts: list[str]) -> str:
    return "\n\n".join(f"--- Message [SRC-{i}]\n{t}" for i, t in enumerate(texts, 1))


def ask(prompts: DataFrame, load: Callable[[], Callable[[str], str]], build: Callable[[str, str], str] = lambda question, context: f"MESSAGES\n{context}\n\nQUESTION\n{question}") -> DataFrame:
    """ask_id, answer, attempts, refs (array of message ids: SRC-1 first), error, of prompts (ask_id, question, messages: array<struct<message_id, date, text>> in the order of their numbers).

    A model that raises Overflow is asked again without the oldest third of the messages (one at
    least, undated first, ties by id), RETRIES times; the rest are numbered anew, so that numbers in the answer are
    those of `refs`. Other errors, and a prompt that never fits, give an empty answer and the error.
    """

    def one(model, question: str, messages: list[dict]) -> tuple:
        left = list(messages)
        for attempt in range(1, RETRIES + 2):
            try:
                return model(build(question, numbered_text([m["text"] or "" for m in left]))), attempt, [m["message_id"] for m in left], None
            except Overflow as e:
                error = f"Overflow: {e}"
                old = sorted(left, key=lambda m: (m["date"] or "", m["message_id"] or ""))[: max(1, len(left) // 3)]
                gone = {id(m) for m in old}
                left = [m for m in left if id(m) not in gone]
            except Exception as e:  # noqa: BLE001  one failed call must not lose the others
                return "", attempt, [], f"{type(e).__name__}: {e}"
        return "", RETRIES + 1, [], error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or load()
            rows = [(r["ask_id"], *one(model, r["question"], r["messages"] or [])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(ASKED.names, r)) for r in rows], schema=ASKED)

    sent = prompts.select(F.col("ask_id").cast("string"), "question", F.transform("messages", lambda m: F.struct(m["message_id"].alias("message_id"), m["date"].cast("string").alias("date"), m["text"].alias("text"))).alias("messages"))
    return sent.mapInArrow(run, "ask_id string, answer string, attempts int, refs array<string>, error string")


ASKED = pa.schema([("ask_id", pa.string()), ("answer", pa.string()), ("attempts", pa.int32()), ("refs", pa.list_(pa.string())), ("error", pa.string())])


def answers(prompts: DataFrame, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """ask_id, answer of prompts (ask_id, prompt). `load` gives the model, once in each task; a model that fails gives an empty answer and its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for p in parts:
            model = model or load()
            out = []
            for q in p["prompt"]:
                try:
                    out.append((model(q), None))
                except Exception as e:  # noqa: BLE001  one failed call must not lose the others
                    out.append(("", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"ask_id": p["ask_id"], "answer": [a for a, _ in out], "error": [e for _, e in out]})

    return prompts.select("ask_id", "prompt").mapInPandas(run, "ask_id string, answer string, error string")


def clamp_temperature(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


#: Ranges in which rows are numbered, at most.
RANGES = 200


def in_order(df: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """The rows with `row_no` from 1, in `order` and then by their values: a sample cuts them in ranges, rows are numbered within these, and what the ranges before hold is added. The sample decides where ranges end, not the numbers. An empty table gives no rows."""
    value = F.struct(*order, *[c for c in df.columns if c not in order])
    sample = df.select(value.alias("v")).orderBy(F.xxhash64("v")).limit(16 * RANGES).agg(F.array_sort(F.collect_set("v")).alias("all"))
    cuts = sample.select(F.filter("all", lambda _, i: i % 16 == 15).alias("cuts"))
    dealt = df.join(F.broadcast(cuts)).withColumn("range_no", F.size(F.filter("cuts", lambda c: c <= value))).drop("cuts")
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("n"))  # a row a range
    before = sizes.select("range_no", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range_no")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(value))
    return dealt.withColumn("place", place).join(F.broadcast(before), "range_no").select(*df.columns, (F.col("before") + F.col("place")).alias("row_no"))


def as_events(df: DataFrame, key: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows as server-sent events, for a web layer to send: event_no from 1 and event of each stream (`key`, or all rows as one), in `order`; the last one of each says that it is done."""
    group = [key] if key else []
    if key:
        placed = df.withColumn("row_no", F.row_number().over(Window.partitionBy(key).orderBy(*(order or df.columns))).cast("long"))
    else:
        placed = in_order(df, order)
    rows = placed.select(*group, F.col("row_no").alias("event_no"), F.concat(F.lit("data: "), F.to_json(F.struct(*df.columns)), F.lit("\n\n")).alias("event"))
    ends = rows.groupBy(*group).agg((F.max("event_no") + 1).alias("event_no")).withColumn("event", F.lit("data: [DONE]\n\n"))
    return rows.unionByName(ends.where("event_no is not null"))


def answer_events(answered: DataFrame, chars: int = 40) -> DataFrame:
    """Events of answers from ask(): pieces of the text of `chars` characters, then the references, then the end."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("answer") / chars).cast("int") - 1, F.lit(0))), lambda i: F.substr("answer", i * chars + 1, F.lit(chars)))
    text = answered.select("ask_id", F.posexplode(pieces).alias("place", "content")).select("ask_id", "place", F.lit("chunk").alias("type"), "content")
    refs = answered.where(F.size("refs") > 0).select("ask_id", F.lit(2_000_000_000).alias("place"), F.lit("ref_map").alias("type"), F.to_json(F.map_from_entries(F.transform("refs", lambda r, i: F.struct(F.concat(F.lit("SRC-"), (i + 1).cast("string")), r)))).alias("content"))
    return as_events(text.unionByName(refs), "ask_id", ("place",))
