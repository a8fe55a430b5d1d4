"""Facts that a language model found in messages, as nested cards and flat tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.substrings import TrigramIndex

CARD = "struct<entities:array<string>,intents:array<string>,commitments:array<struct<who:string,what:string,by_when:string>>,action_items:array<struct<description:string,assignee:string,deadline:string>>,key_facts:array<string>,sentiment:string,topics:array<string>>"


def parse_card(answer: Column) -> Column:
    """A model's answer, with or without a code fence, as a card; null where it is no JSON object."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.when(bare.startswith("{"), F.from_json(bare, CARD, {"mode": "PERMISSIVE"}))


def save(cards: DataFrame, news: DataFrame) -> DataFrame:
    """Cards by email_id; new ones replace old ones."""
    return cards.join(news.select("email_id"), "email_id", "left_anti").unionByName(news)


def entities(cards: DataFrame) -> DataFrame:
    return cards.select("email_id", F.explode("card.entities").alias("entity"))


def people(cards: DataFrame) -> DataFrame:
    """email_id, who of all commitments: what an index of persons is made of."""
    return cards.select("email_id", F.inline("card.commitments")).select("email_id", "who")


def _hit(cards: DataFrame, name: str | None, index: TrigramIndex | None) -> DataFrame:
    if name is None or index is None:
        return cards
    return cards.join(index.like(f"%{name}%").select(F.col("key").alias("email_id")), "email_id", "left_semi")


def intents(cards: DataFrame) -> DataFrame:
    return cards.select("email_id", F.explode("card.intents").alias("intent"))


def commitments(cards: DataFrame, who: str | None = None, index: TrigramIndex | None = None) -> DataFrame:
    """email_id, who, what, by_when; with `who`, those whose person holds it. An index of persons by email_id (`people`) tells which cards to open."""
    out = _hit(cards, who, index).select("email_id", F.inline("card.commitments"))
    return out if who is None else out.where(F.col("who").ilike(f"%{who}%"))


def action_items(cards: DataFrame, assignee: str | None = None) -> DataFrame:
    out = cards.select("email_id", F.inline("card.action_items"))
    return out if assignee is None else out.where(F.col("assignee").ilike(f"%{assignee}%"))


def with_entity(cards: DataFrame, name: str, index: TrigramIndex | None = None) -> DataFrame:
    """The cards with an entity that holds the name: by an index of entities by email_id, or by reading all."""
    if index is not None:
        return _hit(cards, name, index)
    return cards.join(entities(cards).where(F.col("entity").ilike(f"%{name}%")).select("email_id").distinct(), "email_id", "left_semi")


def with_intent(cards: DataFrame, name: str) -> DataFrame:
    return cards.join(intents(cards).where(F.col("intent") == name).select("email_id").distinct(), "email_id", "left_semi")


def stats(cards: DataFrame) -> DataFrame:
    """One pass: counts of cards, distinct entities, commitments and action items."""
    sizes = cards.agg(F.count("*").alias("cards"), F.coalesce(F.sum(F.size(F.coalesce("card.commitments", F.array().cast("array<struct<who:string,what:string,by_when:string>>")))), F.lit(0)).alias("commitments"), F.coalesce(F.sum(F.size(F.coalesce("card.action_items", F.array().cast("array<struct<description:string,assignee:string,deadline:string>>")))), F.lit(0)).alias("action_items"))
    return sizes.join(entities(cards).agg(F.count_distinct("entity").alias("entities")))


#: Calls whose messages are dealt together: a bucket holds so many times the messages of a call, about.
CALLS = 20


def batches(messages: DataFrame, size: int = 5) -> DataFrame:
    """ms (array of message_id and text), `size` messages at most: messages are dealt to buckets by hashes, as many as their number asks for, and each bucket is cut in calls."""
    buckets = F.lit(max(1, -(-messages.count() // (CALLS * size))))
    rows = messages.groupBy(F.pmod(F.xxhash64("message_id", "text"), buckets)).agg(F.sort_array(F.collect_list(F.struct("message_id", "text"))).alias("all"))
    return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(size)), lambda i: F.slice("all", i + 1, size))).alias("ms"))


def bare_json(answer: str) -> str:
    """The answer without a code fence."""
    return re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", answer.strip()))


EXTRACTED = "email_id string, answer string, error string"


def extract(messages: DataFrame, model: Callable[[str], str], size: int = 5, most_chars: int | None = None) -> DataFrame:
    """email_id, answer, error of messages (message_id, text): one call of the model for `size` messages.

    A call gets the messages under `--- Message i ---` and gives a JSON list of cards with
    `email_index` (or one card); an index outside the call is left out. If the answer is no
    JSON, each message gets a call of its own. A call that fails gives its messages the error and no
    answer, and stops nothing else. `most_chars`: of a text, what the model can take; None for all.
    """
    dealt = batches(messages.select("message_id", "text"), size)

    def single(email_id: str, text: str) -> tuple:
        try:
            answer = bare_json(model(text))
            json.loads(answer)
            return email_id, answer, None
        except ValueError as e:
            return email_id, None, f"{type(e).__name__}: {e}"
        except Exception as e:  # noqa: BLE001
            return email_id, None, f"{type(e).__name__}: {e}"

    def called(ms: list) -> list[tuple]:
        texts = [(m["text"] or "")[:most_chars] for m in ms]
        ids = [m["message_id"] for m in ms]
        try:
            found = json.loads(bare_json(model("\n".join(f"--- Message {i} ---\n{t}" for i, t in enumerate(texts)))))
        except ValueError:
            return [single(i, t) for i, t in zip(ids, texts)]
        except Exception as e:  # noqa: BLE001  one failed call must not end the job
            return [(i, None, f"{type(e).__name__}: {e}") for i in ids]
        cards = {}
        for c in found if isinstance(found, list) else [found]:
            at = c.get("email_index", 0) if isinstance(c, dict) else -1
            if isinstance(at, int) and 0 <= at < len(ids):
                cards[at] = json.dumps({k: v for k, v in c.items() if k != "email_index"}, ensure_ascii=False)
        return [(i, cards.get(k), None if k in cards else "no card") for k, i in enumerate(ids)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([r for ms in p["ms"] for r in called(ms)], columns=["email_id", "answer", "error"])

    return dealt.select("ms").mapInPandas(run, EXTRACTED)


def run_extraction(messages: DataFrame, cards: DataFrame, model: Callable[[str], str], size: int = 5) -> DataFrame:
    """The cards with those of messages (message_id, text) that had none; answers that are no cards, and failed calls, are left for the next run."""
    new = extract(unextracted(messages, cards), model, size).select("email_id", parse_card(F.col("answer")).alias("card")).where("card is not null")
    return save(cards, new)


def unextracted(messages: DataFrame, cards: DataFrame) -> DataFrame:
    return messages.join(cards.select(F.col("email_id").alias("message_id")), "message_id", "left_anti")


def context(cards: DataFrame, question: str, most: int | None = 15) -> DataFrame:
    """One row of text: the first `most` commitments and action items (None: all, of cards that fit in one row), where the question asks for such."""
    q = question.lower()
    ask_c, ask_a = any(w in q for w in ("commit", "promise", "agreed")), any(w in q for w in ("action", "todo", "task"))
    first = lambda rows, asked, *order: rows.where(F.lit(asked)) if most is None else rows.orderBy(*order).limit(most if asked else 0)
    c = first(commitments(cards), ask_c, "email_id", "who", "what").select(F.lit(0).alias("k"), F.concat(F.lit("- "), "who", F.lit(": "), "what").alias("line"))
    a = first(action_items(cards), ask_a, "email_id", "description").select(F.lit(1).alias("k"), F.concat(F.lit("- "), "description").alias("line"))
    return c.unionByName(a).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))
