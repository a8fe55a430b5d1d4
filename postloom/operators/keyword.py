"""The keyword index: immutable segments with tombstones, and BM25 by blocks with bounds.

A segment holds the documents of one addition. Its documents are cut in slots of a few hundred of
about equal length, and its postings in blocks, one for each term and slot, with the
largest term frequency and the smallest length in the block. A task sorts and cuts its documents in
runs of bounded size, and a run of slots makes its blocks alone, so postings are never shuffled. A question sums these into an upper
bound for each slot, scores the most promising slots, and then only those whose bound reaches the
score of the last hit so far. Adding documents writes a segment of them, removing writes their ids
and the counts that go with them; statistics are sums over all of these. compact() merges segments of
about one size. A version of the index is a manifest that names its parts.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import tokenize
from postloom.operators.manifest import Manifest

#: Documents of a slot, as a power of two.
SLOT_LOG2 = 8
#: Slots that are scored before a bound is known.
FIRST_SLOTS = 16
#: More slots than these are given to Spark as a table, not as a list.
LISTED_SLOTS = 2000
#: An index of fewer documents is scored in one pass: two more jobs would cost more than the blocks they leave out.
SMALL_DOCS = 100_000
#: Documents whose terms are counted at once.
COUNT_ROWS = 256
#: Documents and postings that a task sorts by length at once, about; where a run ends, a slot ends.
RUN_ROWS = 16_384
RUN_POSTS = 2_000_000
#: Segments of one size (within a factor of TIER) that compact() leaves alone.
TIER = 4


def _counted(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, doc_len, terms, tfs of a batch (doc_id, tokens), of COUNT_ROWS rows at a time: what counting holds doesn't grow with the batch."""
    for at in range(0, b.num_rows, COUNT_ROWS):
        part = b.slice(at, COUNT_ROWS)
        lists = part.column(1)
        length = np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid())
        coded = lists.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        pair, times = np.unique(np.repeat(np.arange(part.num_rows), length) * size + coded.indices.to_numpy(), return_counts=True)
        cuts = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) * size), pa.int32())
        terms = pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(pair % size)).cast(pa.string()))
        tfs = pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int64()), terms, tfs], ["doc_id", "doc_len", "terms", "tfs"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _counted(b)


def _runs(batches: Iterator[pa.RecordBatch], slot_log2: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """slot, doc_id, doc_len, terms, tfs of counted documents: sorted by length in runs, and cut in slots from number `first` on."""
    held, rows, posts = [], 0, 0

    def cut() -> Iterator[pa.RecordBatch]:
        nonlocal first
        t = pa.Table.from_batches(held).sort_by([("doc_len", "ascending"), ("doc_id", "ascending")])
        slots = first + (np.arange(t.num_rows) >> slot_log2)
        first = int(slots[-1]) + 1
        yield from t.add_column(0, "slot", pa.array(slots, pa.int64())).to_batches(max_chunksize=COUNT_ROWS)

    for b in batches:
        if not b.num_rows:
            continue
        held, rows, posts = [*held, b], rows + b.num_rows, posts + len(b.column(2).flatten())
        if rows >= RUN_ROWS or posts >= RUN_POSTS:
            yield from cut()
            held, rows, posts = [], 0, 0
    if held:
        yield from cut()


def _slots_of_blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """term, slot, max_tf, min_len, n, posts of whole slots (slot, doc_id, doc_len, terms, tfs), sorted by term and slot."""
    t = t.combine_chunks()
    lists = t["terms"].combine_chunks()
    doc = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
    if not len(doc):
        return
    coded = lists.flatten().dictionary_encode()
    names = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(names), np.int64)
    rank[names.to_numpy()] = np.arange(len(names))
    slots, slot = np.unique(t["slot"].to_numpy(), return_inverse=True)
    key = rank[coded.indices.to_numpy()] * len(slots) + slot[doc]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    tf, length = t["tfs"].combine_chunks().flatten().to_numpy()[order], t["doc_len"].to_numpy()[doc]
    posts = pa.StructArray.from_arrays([t["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(length)], ["doc_id", "tf", "doc_len"])
    cuts = np.append(starts, len(key))
    terms = coded.dictionary.take(names).take(pa.array(key[starts] // len(slots))).cast(pa.string())
    made = [terms, pa.array(slots[key[starts] % len(slots)]), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), posts)]
    yield from pa.Table.from_arrays(made, ["term", "slot", "max_tf", "min_len", "n", "posts"]).to_batches(max_chunksize=RUN_ROWS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of documents by slot; a slot that goes on in the next batch waits for it."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        slots = t["slot"].to_numpy()
        whole = int(np.flatnonzero(slots != slots[-1])[-1]) + 1 if slots[0] != slots[-1] else 0
        if whole:
            yield from _slots_of_blocks(t.slice(0, whole))
        rest = t.slice(whole)
    if rest is not None:
        yield from _slots_of_blocks(rest)


def _tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), tokenize(F.col(text)).alias("ts"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, doc_len, terms, tfs of each row: tokens are found once, in the JVM, and counted by batch."""
    kind = docs.schema[key].dataType
    return _tokens(docs, key, text).mapInArrow(_counts, f"doc_id {kind.simpleString()}, doc_len long, terms array<string>, tfs array<long>")


def idf_of(df: DataFrame, n: int, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf of (term, df); negative values become `epsilon` times the mean."""
    raw = df.select("term", "df", _raw(n, F.col("df")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _raw(n: int, df: Column) -> Column:
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Index:
    """One version. All documents count in the statistics, also those without words."""

    spark: SparkSession
    path: str
    version: int
    content: dict

    @staticmethod
    def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", slot_log2: int = SLOT_LOG2) -> Index:
        """An index of these documents in the folder `path`, which has none yet."""
        kind = docs.schema[key].dataType.simpleString()
        none = Index(docs.sparkSession, path.rstrip("/"), -1, {"segments": [], "deletes": [], "key": kind, "slot_log2": slot_log2, "n": 0, "tokens": 0, "mean": 0.0})
        return none._commit([none._segment(_tokens(docs, key, text), _counts)], [])

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
        at, content = Manifest(spark, f"{path.rstrip('/')}/versions").read(version)
        if at < 0:
            raise FileNotFoundError(f"{path}: no index")
        return Index(spark, path.rstrip("/"), at, content)

    # --- writing ----------------------------------------------------------------------------------

    def _segment(self, rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> dict:
        """Writes a segment: forward (slot, doc_id, doc_len, terms, tfs), blocks, and terms. `count` makes counted documents of the rows, where they aren't yet."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        kind, slot_log2 = self.content["key"], self.content["slot_log2"]
        rows.mapInArrow(lambda batches: _runs(count(batches), slot_log2, TaskContext.get().partitionId() << 33), f"slot long, doc_id {kind}, doc_len long, terms array<string>, tfs array<long>").write.parquet(f"{at}/forward")
        forward = self.spark.read.parquet(f"{at}/forward").select("slot", "doc_id", "doc_len", "terms", "tfs")
        forward.mapInArrow(_blocks, f"term string, slot long, max_tf long, min_len long, n long, posts array<struct<doc_id: {kind}, tf: bigint, doc_len: bigint>>").write.parquet(f"{at}/blocks")
        self.spark.read.parquet(f"{at}/blocks").groupBy("term").agg(F.sum("n").alias("df")).sortWithinPartitions("term").write.parquet(f"{at}/terms")
        sizes = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
        return {"name": name, "n": sizes["n"], "tokens": sizes["tokens"]}

    def _commit(self, segments: list[dict], deletes: list[dict]) -> Index:
        """The version of these parts; its sums, and the mean that stands in for negative weights, are in the manifest."""
        sums = {c: sum(s[c] for s in segments) - sum(d[c] for d in deletes) for c in ("n", "tokens")}
        made = replace(self, content=self.content | sums | {"segments": segments, "deletes": deletes})
        mean = made._dfs().agg(F.avg(_raw(sums["n"], F.col("df"))).alias("m")).first()["m"]
        content = made.content | {"mean": mean or 0.0}
        return replace(self, version=Manifest(self.spark, f"{self.path}/versions").commit(self.version, content), content=content)

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        """The index with those of `docs` whose ids it lacks, as a segment of their own. Nothing else is tokenized or written."""
        fresh = docs.join(self.documents().select(F.col("doc_id").alias(key)), key, "left_anti")
        made = self._segment(_tokens(fresh, key, text), _counts)
        return self._commit([*self.content["segments"], made], self.content["deletes"]) if made["n"] else self

    def remove(self, ids: DataFrame, key: str = "doc_id") -> Index:
        """The index without these documents: their ids by segment, and the counts of their terms, are written."""
        gone = self.documents("terms").join(ids.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
        name = uuid.uuid4().hex
        at = f"{self.path}/deletes/{name}"
        gone.select("segment", "doc_id", "doc_len", "terms").write.parquet(f"{at}/all")
        written = self.spark.read.parquet(f"{at}/all")
        written.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/terms")
        sizes = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
        if not sizes["n"]:
            return self
        return self._commit(self.content["segments"], [*self.content["deletes"], {"name": name, "n": sizes["n"], "tokens": sizes["tokens"]}])

    def compact(self, tier: int = TIER, whole: bool = False) -> Index:
        """Where `tier` segments or more are of one size (by powers of `tier`), they become one without the removed documents; with `whole` all do."""
        sizes: dict[int, list[dict]] = {}
        for s in self.content["segments"]:
            sizes.setdefault(0 if whole else int(math.log(max(1, s["n"]), tier)), []).append(s)
        merged = [s for group in sizes.values() if len(group) >= (1 if whole else tier) for s in group]
        if not merged:
            return self
        names = [s["name"] for s in merged]
        made = self._segment(self.documents("terms", "tfs").where(F.col("segment").isin(names)).select("doc_id", "doc_len", "terms", "tfs"))
        kept = [s for s in self.content["segments"] if s["name"] not in names]
        return self._commit([*kept, made], self._deletes_outside(names))

    def _deletes_outside(self, names: list[str]) -> list[dict]:
        """The tombstones of documents in other segments, written anew."""
        if not self.content["deletes"]:
            return []
        rest = self._tombstones().where(~F.col("segment").isin(names))
        name = uuid.uuid4().hex
        rest.write.parquet(f"{self.path}/deletes/{name}/all")
        written = self.spark.read.parquet(f"{self.path}/deletes/{name}/all")
        written.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/deletes/{name}/terms")
        sizes = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
        return [{"name": name, "n": sizes["n"], "tokens": sizes["tokens"]}] if sizes["n"] else []

    # --- reading ------------------------------------------------------------------------------------

    def _read(self, kind: str, part: str) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/{kind}/{s['name']}/{part}").withColumn("segment", F.lit(s["name"])) if kind == "segments" else self.spark.read.parquet(f"{self.path}/{kind}/{s['name']}/{part}") for s in self.content[kind]]

    def _tombstones(self) -> DataFrame | None:
        return _union(self._read("deletes", "all")) if self.content["deletes"] else None

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Without removed documents; `rows` have segment and doc_id."""
        gone = self._tombstones()
        return rows if gone is None else rows.join(gone.select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")

    def documents(self, *columns: str) -> DataFrame:
        """segment, doc_id, doc_len (and terms, tfs) of the documents in the index."""
        parts = self._read("segments", "forward")
        return self._alive(_union(parts).select("segment", "doc_id", "doc_len", *columns)) if parts else self.spark.createDataFrame([], f"segment string, doc_id {self.content['key']}, doc_len long, terms array<string>, tfs array<long>").select("segment", "doc_id", "doc_len", *columns)

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, doc_len"""
        return self.documents("terms", "tfs").select("doc_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))), "doc_len").select("doc_id", "term", "tf", "doc_len")

    def _dfs(self) -> DataFrame:
        """term, df of all terms that documents have: sums over the segments less those of removed documents."""
        more, less = [p.select("term", "df") for p in self._read("segments", "terms")], [p.select("term", (-F.col("df")).alias("df")) for p in self._read("deletes", "terms")]
        return more[0] if len(more) == 1 and not less else _union([*more, *less]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def terms(self) -> DataFrame:
        """term, df, idf"""
        return idf_of(self._dfs(), self.content["n"])

    @property
    def avg_len(self) -> float | None:
        return self.content["tokens"] / self.content["n"] if self.content["n"] else None

    def weights(self, words: list[str], epsilon: float = 0.25) -> dict[str, float]:
        """idf of the words that documents have; only these are read."""
        parts = _union([p.select("term", "df").where(F.col("term").isin(words)) for p in self._read("segments", "terms")] + [p.select("term", (-F.col("df")).alias("df")).where(F.col("term").isin(words)) for p in self._read("deletes", "terms")])
        found = parts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").select("term", _raw(self.content["n"], F.col("df")).alias("raw")).collect()
        return {r["term"]: r["raw"] if r["raw"] >= 0 else epsilon * self.content["mean"] for r in found}


@dataclass(frozen=True)
class Search:
    """How a question is answered: the weights (times idf) of its words, `first` slots with their scores' table, the score to `reach`, and the `rest` of the slots that may hold one."""

    index: Index
    weights: dict[str, float]
    n: int
    ids: DataFrame | None
    k1: float
    b: float

    def _gain(self, tf: Column, length: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.index.avg_len))

    def _weight(self) -> Column:
        return F.element_at(F.create_map(*[x for w, v in self.weights.items() for x in (F.lit(w), F.lit(v))]), F.col("term"))

    def blocks(self) -> DataFrame:
        """The blocks of the question's words; what isn't selected of them isn't read."""
        return _union(self.index._read("segments", "blocks")).where(F.col("term").isin(list(self.weights)))

    def slots(self) -> DataFrame:
        """segment, slot, bound: no document of the slot scores more."""
        most = F.greatest(self._weight() * self._gain(F.col("max_tf"), F.col("min_len")), F.lit(0.0))
        return self.blocks().select("segment", "slot", most.alias("most")).groupBy("segment", "slot").agg(F.sum("most").alias("bound"))

    def scored(self, blocks: DataFrame) -> DataFrame:
        """doc_id, score (above 0) of the documents of some blocks. A document's postings all lie in one slot."""
        posts = blocks.select("segment", "term", F.inline("posts"))
        posts = self.index._alive(posts)
        if self.ids is not None:
            posts = posts.join(self.ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        part = self._weight() * self._gain(F.col("tf"), F.col("doc_len"))
        return posts.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")

    def within(self, slots: list) -> DataFrame:
        """The blocks of listed slots."""
        by: dict[str, list[int]] = {}
        for s in slots:
            by.setdefault(s["segment"], []).append(s["slot"])
        return self.blocks().where(reduce(Column.__or__, [(F.col("segment") == k) & F.col("slot").isin(v) for k, v in by.items()]))

    def passes(self) -> tuple[list, list, DataFrame | None]:
        """(slots of the first pass, their best hits, blocks of the second pass or None if there are none)."""
        slots = self.slots()
        first = slots.orderBy(F.desc("bound"), "segment", "slot").limit(FIRST_SLOTS).collect()
        if not first:
            return [], [], None
        best = self.scored(self.within(first)).orderBy(F.desc("score"), "doc_id").limit(self.n).collect()
        reach = best[-1]["score"] if len(best) == self.n else 0.0
        seen = reduce(Column.__or__, [(F.col("segment") == s["segment"]) & (F.col("slot") == s["slot"]) for s in first])
        rest = slots.where((F.col("bound") + 1e-6 >= reach) & ~seen)
        if len(first) < FIRST_SLOTS:
            return first, best, None
        listed = rest.limit(LISTED_SLOTS + 1).collect()
        if not listed:
            return first, best, None
        if len(listed) <= LISTED_SLOTS:
            return first, best, self.within(listed)
        return first, best, self.blocks().join(rest.select("segment", "slot"), ["segment", "slot"], "left_semi")


def search(index: Index, question: str, n: int, ids: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> Search | None:
    """The search of a question's words, repeated words counting repeatedly; None if no document has any of them."""
    asked = Counter(index.spark.range(1).select(tokenize(F.lit(question)).alias("ts")).first()["ts"] or [])
    found = index.weights(sorted(asked)) if asked and index.content["segments"] else {}
    return Search(index, {w: asked[w] * v for w, v in found.items()}, n, ids, k1, b) if found else None


def bm25(index: Index, question: str, n: int, ids: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc_id and score of the n best by Okapi BM25 with scores above 0, ties by id. `ids` (id): the documents a filter leaves; statistics are of all."""
    asked = search(index, question, n, ids, k1, b)
    shape = f"doc_id {index.content['key']}, score double"
    if asked is None:
        return index.spark.createDataFrame([], shape)
    if index.content["n"] < SMALL_DOCS:
        return asked.scored(asked.blocks()).orderBy(F.desc("score"), "doc_id").limit(n)
    _, best, rest = asked.passes()
    hits = index.spark.createDataFrame([(r["doc_id"], r["score"]) for r in best], shape)
    if rest is not None:
        hits = hits.unionByName(asked.scored(rest))
    return hits.orderBy(F.desc("score"), "doc_id").limit(n)
