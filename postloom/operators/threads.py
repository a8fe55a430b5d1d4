"""Threads: their latest message, five rules of state, buckets, timelines and task tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATEST = ("message_id", "date", "sender", "sender_name", "subject", "direction", "is_replied", "is_read", "mine")


def latest(messages: DataFrame) -> DataFrame:
    """One row for each conversation: its latest message (undated first, ties by id), count, and whether all are notes. One partial aggregation; blank conversations are left out."""
    m = messages.where("coalesce(conversation_id, '') <> ''")
    key = F.struct(F.coalesce(F.col("date").cast("string"), F.lit("")), F.col("message_id"))
    grouped = m.groupBy("conversation_id").agg(F.max_by(F.struct(*LATEST), key).alias("l"), F.count("*").alias("message_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.bool_and(F.col("email_type") == "meeting_note").alias("all_notes"))
    return grouped.select("conversation_id", "message_count", "first_date", "last_date", "all_notes", "l.*")


def is_stale(date: Column, now: str, days: int = 14) -> Column:
    """Strictly more than `days` before `now`; undated messages are not stale."""
    return F.coalesce(date < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def thread_state(now: str) -> Column:
    stale, mine = is_stale(F.col("date"), now), F.col("mine")
    return F.when(stale & mine, "stale").when(stale, "stale_needs_action").when(mine, "awaiting_response").when(F.col("is_replied"), "completed").otherwise("needs_action")


def standalone_state(now: str) -> Column:
    return F.when(F.col("mine"), "awaiting_response").when(F.col("is_replied"), "completed").when(is_stale(F.col("date"), now), "stale_needs_action").otherwise("needs_action")


def research_state() -> Column:
    sent = F.col("direction") == "sent"
    return F.when(~sent & ~F.col("is_replied"), "needs_action").when(sent, "awaiting_response").otherwise("completed")


def prompt_state() -> Column:
    sent, replied = F.col("direction") == "sent", F.col("is_replied")
    return F.when(sent & ~replied, "AWAITING RESPONSE").when(~sent & ~replied, "NEEDS ACTION").otherwise("COMPLETED")


def model_flags() -> tuple[Column, Column]:
    """(awaiting a response, needs action)"""
    sent, replied = F.col("direction") == "sent", F.col("is_replied")
    return sent & ~replied, ~sent & ~replied & ~F.col("is_read")


def thread_states(messages: DataFrame, now: str) -> DataFrame:
    """Each thread that is not made of notes only, with its state."""
    return latest(messages).where("not all_notes").withColumn("state", thread_state(now))


def standalone_states(messages: DataFrame, now: str) -> DataFrame:
    """Each message without a conversation that is no note, with its state."""
    return messages.where("coalesce(conversation_id, '') = '' and coalesce(email_type, '') <> 'meeting_note'").withColumn("state", standalone_state(now))


def buckets(messages: DataFrame, now: str) -> DataFrame:
    """needs_action, awaiting_response and stale (both kinds); completed threads are left out."""
    both = thread_states(messages, now).select("conversation_id", "message_id", "subject", "date", "state").unionByName(standalone_states(messages, now).select(F.lit("").alias("conversation_id"), "message_id", "subject", "date", "state"))
    return both.where("state <> 'completed'").withColumn("bucket", F.when(F.col("state").isin("stale", "stale_needs_action"), "stale").otherwise(F.col("state"))).drop("state")


def timeline(messages: DataFrame) -> DataFrame:
    """One row for each thread or message of its own: dates, count, participants (sorted), subject and status."""
    names = messages.where("coalesce(conversation_id, '') <> ''").groupBy("conversation_id").agg(F.array_join(F.sort_array(F.collect_set("sender")), ",").alias("participants"))
    threads = latest(messages).join(names, "conversation_id").select(F.col("conversation_id").alias("id"), "first_date", "last_date", "message_count", "participants", "subject", research_state().alias("status"))
    alone = messages.where("coalesce(conversation_id, '') = ''").select(F.col("message_id").alias("id"), F.col("date").alias("first_date"), F.col("date").alias("last_date"), F.lit(1).cast("long").alias("message_count"), F.col("sender").alias("participants"), "subject", research_state().alias("status"))
    return threads.unionByName(alone)


def tagged_tasks(open_threads: DataFrame, deadline_hits: DataFrame, question_hits: DataFrame) -> DataFrame:
    """needs_action threads with tags by whether their subject is among the hits' subjects."""
    flag = lambda hits, name: hits.select("subject").where("coalesce(subject, '') <> ''").distinct().withColumn(name, F.lit(name))
    tagged = open_threads.where("bucket = 'needs_action'").join(flag(deadline_hits, "deadline"), "subject", "left").join(flag(question_hits, "question"), "subject", "left")
    return tagged.withColumn("tags", F.array_join(F.array_compact(F.array("deadline", "question")), ",")).drop("deadline", "question")


def task_counts(buckets_: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row: open threads by bucket, and how many that need action have a deadline or a question."""
    of = lambda b: F.count_if(F.col("bucket") == b)
    n = buckets_.agg(F.count("*").alias("total_open"), of("needs_action").alias("needs_action"), of("awaiting_response").alias("awaiting_response"), of("stale").alias("stale"))
    has = lambda t: F.count_if(F.array_contains(F.split("tags", ","), t))
    return n.join(tagged.agg(has("deadline").alias("with_deadlines"), has("question").alias("with_questions")))
