"""From a question to hits and context, in one call: wording, filter, candidates, fusion, rerank, threshold, threads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.config import Config
from postloom.functions import filters
from postloom.operators import keyword, search

# Least relevance, by what is asked for.
THRESHOLDS = {"research": 0.3, "topic_map": 0.25, "entity_map": 0.45}


@dataclass(frozen=True)
class Corpus:
    """`documents` (id, document, and the columns that filters name), `vectors` (id, embedding), and the keyword index of the documents, which what looks among vectors only does without."""

    documents: DataFrame
    vectors: DataFrame
    index: keyword.Index | None = None


def question_where(question: str, now: datetime) -> dict:
    """The filter that a question's wording asks for."""
    return filters.build_where(filters.question_filter(filters.kind_of(question)), filters.time_range(question, now))


def retrieve(corpus: Corpus, question: str, vector: list[float], n: int, where: dict | None = None, config: Config = Config(), model: Callable[[], Callable[[str, list[str]], list[float]]] | None = None, above: float | None = None, rerank: bool = True) -> DataFrame:
    """id, rrf_score, relevance, rerank_score (null where nothing was reranked) and place (from 1) of the n best hits.

    config.candidates(n) hits of each branch, filtered before they are cut, are fused; if there are
    more than n, they are reranked by `model` (loaded in the task; gets the question and documents),
    or by the overlap of words where there is none, unless `rerank` is false. `above`: only hits of more than this relevance.
    A filter that leaves no vectors is dropped for that branch. The hits of the branches are found at once, as rows of
    local tables, so that neither vectors nor documents are read again or shuffled for what follows.
    """
    return retrieve_each(corpus, [(question, vector, n, rerank)], where, config, model, above)[0]


def retrieve_each(corpus: Corpus, asks: list[tuple[str, list[float], int, bool]], where: dict | None = None, config: Config = Config(), model: Callable[[], Callable[[str, list[str]], list[float]]] | None = None, above: float | None = None) -> list[DataFrame]:
    """retrieve() of several (question, vector, n, rerank): the vectors are read once for all of them."""
    keep = filters.compile_filter(where)
    ids = corpus.documents.where(keep).select("id") if where else None
    queries = [(vector, config.candidates(n)) for _, vector, n, _ in asks]
    near = nearest(corpus.vectors if ids is None else corpus.vectors.join(ids, "id", "left_semi"), queries)
    if ids is not None and all(h.isEmpty() for h in near):
        near = nearest(corpus.vectors, queries)
    return [_placed(corpus, question, h, n, ids, config, model, above, rerank) for (question, _, n, rerank), h in zip(asks, near)]


def nearest(vectors: DataFrame, queries: list[tuple[list[float], int]]) -> list[DataFrame]:
    """Of each (vector, n): the n nearest, held. Several are found in one pass over the vectors."""
    if len(queries) == 1:
        return [held(search.knn(vectors, *queries[0]))]
    every = held(search.knn_each(vectors, [q for q, _ in queries], max(n for _, n in queries)))
    return [every.where((F.col("query_no") == i) & (F.col("place") <= n)).select("id", "distance", "relevance") for i, (_, n) in enumerate(queries)]


def _placed(corpus: Corpus, question: str, near: DataFrame, n: int, ids: DataFrame | None, config: Config, model: Callable[[], Callable[[str, list[str]], list[float]]] | None, above: float | None, rerank: bool) -> DataFrame:
    """The n best hits of a question, from the nearest vectors and its words."""
    many = config.candidates(n)
    words = keyword.bm25(corpus.index, question, many, ids)
    fused = held(search.hybrid(near, words, 2 * many, config.rrf_k, config.unscored_relevance))  # 2 * many rows at most
    counted = fused.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))
    scored = counted.withColumn("rerank_score", F.lit(None).cast("double")) if not rerank else rerank_scores(counted.join(documents_of(corpus, fused), "id", "left"), question, model)
    scored = scored.withColumn("rerank_score", F.when(F.col("total") > n, F.col("rerank_score")))
    best = scored.orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), "id").limit(n)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), "id")).cast("long"))
    hits = placed.select("id", "rrf_score", "relevance", "rerank_score", "place")
    return hits if above is None else hits.where(F.col("relevance") > above)


def held(hits: DataFrame) -> DataFrame:
    """A top-k as rows of a local table: found once. Spark knows how few they are, so joins send them to the large side."""
    return hits.sparkSession.createDataFrame(hits.toArrow(), hits.schema)


def documents_of(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """id, document of a top-k, whose ids go to the documents: their texts aren't shuffled."""
    return corpus.documents.select("id", "document").join(F.broadcast(hits.select("id")), "id", "left_semi")


def rerank_scores(hits: DataFrame, question: str, model: Callable[[], Callable[[str, list[str]], list[float]]] | None = None, most_chars: int = 1500) -> DataFrame:
    """Adds rerank_score to hits (with `document`). A model reads the first `most_chars` characters, as cross-encoders do; without one, the overlap of words of whole documents counts."""
    if model is None:
        return hits.withColumn("rerank_score", search.overlap_score(question, F.coalesce("document", F.lit(""))))
    names = hits.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for p in parts:
            scorer = scorer or model()
            yield p.assign(rerank_score=[float(x) for x in scorer(question, [(t or "")[:most_chars] for t in p["document"]])])[[*names, "rerank_score"]]

    return hits.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in hits.schema)}, rerank_score double")


def with_threads(messages: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits' messages with all of their threads. `hits`: retrieve() of messages, by message_id."""
    found = hits.select(F.col("id").alias("message_id")).join(messages.select("message_id", "conversation_id"), "message_id")
    return search.expand_threads(messages, found)


def summary_hits(corpus: Corpus, vectors: dict[str, list[float]], n: int = 5) -> DataFrame:
    """kind, id, relevance of the hits that an inbox summary shows: received and sent messages without a reply, nearest to the two standing questions. `vectors`: those of QUESTIONS, by kind."""
    kinds = (("action_needed", "received"), ("awaiting_response", "sent"))
    out = [search.knn(corpus.vectors.join(corpus.documents.where((F.col("direction") == way) & ~F.col("is_replied")).select("id"), "id", "left_semi"), vectors[k], n).select(F.lit(k).alias("kind"), "id", "relevance") for k, way in kinds]
    return out[0].unionByName(out[1])


# Standing questions.
QUESTIONS = {
    "action_needed": "action required response needed deadline",
    "awaiting_response": "sent waiting for response",
    "deadline": "deadline due date by end of urgent asap",
    "question": "question can you could you please let me know",
}


def task_hits(corpus: Corpus, vectors: dict[str, list[float]], n: int = 10) -> dict[str, DataFrame]:
    """By tag: id and relevance of the n unanswered received messages nearest to the standing question."""
    open_ids = corpus.documents.where("direction = 'received' and not is_replied").select("id")
    return {tag: search.knn(corpus.vectors.join(open_ids, "id", "left_semi"), vectors[tag], n) for tag in ("deadline", "question")}
