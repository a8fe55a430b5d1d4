"""From a question, a topic or a meeting to what a model is asked, and to maps, each in one call.

Each begins with searches over the mailbox, keeps hits of enough relevance, and takes their threads along. Hits
are tens, and so is what follows from them; everything before that is the search's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.config import Config
from postloom.functions import filters
from postloom.operators import context, graph, retrieval, search, threads
from postloom.operators.retrieval import THRESHOLDS, Corpus


@dataclass(frozen=True)
class Mailbox:
    """`messages` (with document columns), the `corpus` of the same messages by message_id, and `embed`, which gives a question's vector."""

    messages: DataFrame
    corpus: Corpus
    embed: Callable[[str], list[float]]

    def search(self, question: str, n: int, **settings) -> DataFrame:
        """The n best hits, found once: as rows of a local table, for what follows reads them several times."""
        return retrieval.held(retrieval.retrieve(self.corpus, question, self.embed(question), n, **settings))

    def search_each(self, asks: list[tuple[str, int, bool]], **settings) -> list[DataFrame]:
        """search() of several (question, n, rerank): the vectors are read once for all of them."""
        return [retrieval.held(hits) for hits in retrieval.retrieve_each(self.corpus, [(q, self.embed(q), n, rerank) for q, n, rerank in asks], **settings)]


@dataclass(frozen=True)
class Found:
    """`hits` (id, relevance, place, query_no) and `messages`: the hits and what of their threads was taken along, with hit_rank for hits."""

    hits: DataFrame
    messages: DataFrame

    def counts(self) -> DataFrame:
        """One row: emails_found, threads_included."""
        n = self.hits.agg(F.count("*").alias("emails_found"))
        return n.join(self.messages.agg(F.count_distinct(F.nullif("conversation_id", F.lit(""))).alias("threads_included")))


def united(lists: list[DataFrame]) -> DataFrame:
    """The hits of several searches, each where it first appears: id, relevance, query_no, place (from 1 over all)."""
    every = reduce(DataFrame.unionByName, [h.select("id", "relevance", "place").withColumn("query_no", F.lit(i)) for i, h in enumerate(lists, 1)])
    first = every.groupBy("id").agg(F.min(F.struct("query_no", "place", "relevance")).alias("f")).select("id", "f.query_no", F.col("f.place").alias("at"), "f.relevance")
    order = search.ranked(first.withColumn("order", -(F.col("query_no") * 1000 + F.col("at"))), "order", "id")
    return first.join(order, "id").select("id", "relevance", "query_no", F.col("rank").alias("place"))


def _with_messages(box: Mailbox, hits: DataFrame, partly: bool = False) -> Found:
    """`partly`: threads of the first half of the hits only. The hits' messages are looked up once."""
    kept = hits if "query_no" in hits.columns else hits.withColumn("query_no", F.lit(1))
    named = retrieval.held(kept.select(F.col("id").alias("message_id"), F.col("place").alias("rank")).join(box.messages.select("message_id", "conversation_id"), "message_id"))
    if partly:  # places of what a threshold left
        named = named.drop("rank").join(search.ranked(named.withColumn("order", -F.col("rank")), "order", "message_id").withColumnRenamed("id", "message_id"), "message_id")
    taken = search.expand_some(box.messages, named) if partly else search.expand_threads(box.messages, named)
    return Found(kept, taken.join(named.select("message_id", F.col("rank").alias("hit_rank")), "message_id", "left"))


def for_question(box: Mailbox, question: str, now: datetime, n: int = 30, config: Config = Config(), **settings) -> Found:
    """What answers a question: the filter that its wording asks for, the search, and the hits' threads."""
    return _with_messages(box, box.search(question, n, where=retrieval.question_where(question, now), config=config, **settings))


def for_meeting(box: Mailbox, subject: str, attendees: list[str], most_attendees: int | None = 3, **settings) -> Found:
    """What prepares a meeting: by its subject, by its first attendees, and by summaries of earlier ones; hits count where they first appear."""
    asks = [(subject, 10, True)] if subject else []
    asks += [(a, 5, False) for a in attendees[:most_attendees] if a]
    asks += [(f"meeting summary notes {subject}", 5, False)] if subject else []
    if not asks:
        none = box.messages.limit(0)
        return _with_messages(box, none.select(F.col("message_id").alias("id"), F.lit(0.0).alias("relevance"), F.lit(0).alias("query_no"), F.lit(0).cast("long").alias("place")))
    return _with_messages(box, united(box.search_each(asks, **settings)))


def for_research(box: Mailbox, topic: str, n: int = 50, **settings) -> Found:
    return _with_messages(box, box.search(topic, n, rerank=False, above=THRESHOLDS["research"], **settings))


def research_timeline(found: Found) -> DataFrame:
    """Threads and messages of their own, in the order of time by `first_date`."""
    return threads.timeline(found.messages)


def topic_map(box: Mailbox, topic: str, n: int = 50, **settings) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what a search for the topic found."""
    found = _with_messages(box, box.search(topic, n, rerank=False, above=THRESHOLDS["topic_map"], **settings))
    return graph.topic_map_nodes(found.messages), graph.topic_map_edges(found.messages)


def entity_map(box: Mailbox, subject: str, n: int = 30, **settings) -> Found:
    """What an entity map is made of: reranked hits of high relevance, and threads of their first half. graph.entity_nodes(), entity_stats() and the edges take its messages."""
    return _with_messages(box, box.search(subject, n, above=THRESHOLDS["entity_map"], **settings), partly=True)


def prompt_rows(found: Found, ask_id: str, question: str, budget: tuple[int, int]) -> DataFrame:
    """One row for context.ask(): ask_id, question, and the messages of the prompt in the order of their numbers, rendered, as many and as long as the budget takes."""
    most, chars = budget
    numbered = context.numbered(found.messages).where(F.col("ref") <= most)
    held = numbered.select("ref", "message_id", F.col("date").cast("string").alias("date"), context.render(chars).alias("text"))
    rows = held.agg(F.sort_array(F.collect_list(F.struct("ref", "message_id", "date", "text"))).alias("messages"))
    return rows.select(F.lit(ask_id).alias("ask_id"), F.lit(question).alias("question"), F.transform("messages", lambda m: F.struct(m["message_id"], m["date"], m["text"])).alias("messages"))


def answered(box: Mailbox, question: str, now: datetime, load: Callable[[], Callable[[str], str]], ask_id: str = "1", n: int | None = None, local: bool = False, config: Config = Config(), **settings) -> DataFrame:
    """One row: ask_id, answer, attempts, refs, error, query_type, emails_found, threads_included. The question goes all the way: wording, filter, search, threads, budget, model."""
    budget = config.budget(local)
    found = for_question(box, question, now, n or budget[0], config, **settings)
    said = context.ask(prompt_rows(found, ask_id, question, budget), load)
    return said.withColumn("query_type", F.lit(filters.kind_of(question))).join(found.counts())


def sources(box: Mailbox, found: Found, most: int = 10) -> DataFrame:
    """place, message_id, sender, subject, date, relevance (per cent) of the first hits, as an answer names them."""
    top = found.hits.where(F.col("place") <= most).select(F.col("id").alias("message_id"), "place", F.round(100 * F.col("relevance"), 1).alias("relevance"))
    name = F.coalesce(F.nullif("sender_name", F.lit("")), "sender")
    return box.messages.join(top, "message_id").select("place", "message_id", name.alias("sender"), "subject", "date", "relevance")
