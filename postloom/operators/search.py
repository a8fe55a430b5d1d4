"""Retrieval: nearest vectors, rank fusion, reranking and thread expansion.

Filters apply before a top-k, so they reach the scan and lose nothing. Rankings break ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import tokenize
from postloom.functions.vectors import cosine


def knn(vectors: DataFrame, query: list[float], n: int, where: Column | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The n nearest by cosine: id, distance, relevance (1 - distance). A top-k in each task, then one of those."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(key).alias("id"), F.round(cosine(F.col(vector), q), 6).alias("relevance")).where("relevance is not null")
    return scored.orderBy(F.desc("relevance"), "id").limit(n).select("id", F.round(1 - F.col("relevance"), 6).alias("distance"), "relevance")


def knn_each(vectors: DataFrame, queries: list[list[float]], n: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """knn() of several queries in one pass over the vectors: query_no (from 0), id, distance, relevance, place (from 1). A task hands on the n best of each."""
    near = F.array(*[F.struct(F.lit(i).alias("query_no"), F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in q])), 6).alias("relevance")) for i, q in enumerate(queries)])
    scored = vectors.select(F.col(key).alias("id"), F.inline(near)).where("relevance is not null")
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("relevance"), "id"))).where(F.col("place") <= n)
    return placed.select("query_no", "id", F.round(1 - F.col("relevance"), 6).alias("distance"), "relevance", "place")


def knn_or_all(vectors: DataFrame, query: list[float], n: int, where: Column, **names) -> DataFrame:
    """knn(); if the filter leaves nothing, without it."""
    hits = knn(vectors, query, n, where, **names)
    none = hits.agg(F.count("*").alias("hits")).where("hits = 0").select(F.lit(1).alias("empty"))
    return hits.unionByName(knn(vectors, query, n, None, **names).join(none).drop("empty"))


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank from 1): id, rrf_score."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf_score"))


def ranked(hits: DataFrame, score: str, key: str) -> DataFrame:
    """(id, rank) of a top-k; the window sees k rows at most."""
    return hits.select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long").alias("rank"))


def hybrid(near: DataFrame, words: DataFrame, n: int, k: int = 60, unscored: float = 0.5) -> DataFrame:
    """Fusion of knn() and bm25() hits; hits of words alone get the relevance `unscored`."""
    both = fuse([ranked(near, "relevance", "id"), ranked(words, "score", "doc_id")], k)
    return both.join(near.select("id", "relevance"), "id", "left").select("id", "rrf_score", F.coalesce("relevance", F.lit(unscored)).alias("relevance")).orderBy(F.desc("rrf_score"), "id").limit(n)


def overlap_score(question: str, text: Column) -> Column:
    """Jaccard similarity of the words of whole texts; what ranks where no model is plugged in."""
    q = F.array_distinct(tokenize(F.lit(question)))
    d = F.array_distinct(tokenize(text))
    return F.round(F.size(F.array_intersect(q, d)) / F.greatest(F.size(F.array_union(q, d)), F.lit(1)), 6)


def rerank(hits: DataFrame, question: str, n: int, text: str = "text", key: str = "id") -> DataFrame:
    return hits.withColumn("rerank_score", overlap_score(question, F.col(text))).orderBy(F.desc("rerank_score"), key).limit(n)


def expand_threads(messages: DataFrame, hits: DataFrame) -> DataFrame:
    """All messages of the hits' threads, and hits without a thread; each once, in one pass over the messages. `hits`: message_id, conversation_id."""
    key = F.when(F.coalesce("conversation_id", F.lit("")) != "", F.concat(F.lit("thread:"), "conversation_id")).otherwise(F.concat(F.lit("message:"), "message_id")).alias("taken_by")
    return messages.select("*", key).join(hits.select(key).distinct(), "taken_by", "left_semi").drop("taken_by").dropDuplicates(["message_id"])


def expand_some(messages: DataFrame, hits: DataFrame) -> DataFrame:
    """expand_threads() of the first n // 2 + 1 hits by rank, and the other hits themselves."""
    n = hits.agg((F.floor(F.count("*") / 2) + 1).alias("top"))
    marked = hits.join(F.broadcast(n))
    full = expand_threads(messages, marked.where("rank <= top"))
    rest = messages.join(marked.where("rank > top").select("message_id"), "message_id", "left_semi").join(full.select("message_id"), "message_id", "left_anti")
    return full.unionByName(rest)


def first_appearance(lists: DataFrame) -> DataFrame:
    """id, query_no, rank of each id's first appearance in (query_no, rank)."""
    return lists.groupBy("id").agg(F.min(F.struct("query_no", "rank")).alias("f")).select("id", "f.query_no", "f.rank")
