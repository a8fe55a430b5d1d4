"""Approximate nearest neighbours: cells of product-quantized vectors, searched by look-up tables and reranked exactly.

Every vector with a direction is kept, as a unit vector, under the nearest of some centres. What is left of
it beside the centre is cut in subspaces, and in each the nearest of up to 256 words stands for it: a code
of one byte each. Files are laid out by cell. A query looks into its nearest cells: codes are scored by
look-up tables (the inner product with a centre, and with each word), and the best few are compared with
the query as they are. Cells that no query wants are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.vectors import dot

#: Vectors of a block of codes, and queries that meet a block at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 256
#: Distances from rows to centres that are held at once, however many of either there are.
CELL_PAIRS = 1 << 20
#: Vectors of a cell that one file takes, about; larger cells have several.
FILE_ROWS = 200_000
#: Vectors, and queries, that meet at once where all are compared; and pairs of these scored at a time.
EXACT_ROWS, EXACT_PAIRS = 1 << 16, 1 << 22
#: Meetings that a small comparison is cut into, so that it has tasks enough.
EXACT_MEETINGS = 64
#: Candidates for each neighbour asked for, tried in this order when fitting.
SHORTLISTS = (4, 8, 16, 32, 64)


def _unit(v: Column) -> Column:
    """The vector as doubles, scaled to length 1; null for one of length 0."""
    doubles = v.cast("array<double>")
    length = F.sqrt(dot(doubles, doubles))
    return F.when(length > 0, F.transform(doubles, lambda x: x / length))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Codebook:
    """`centers` of the cells (k x d), and `words` of the subspaces (m x w x d/m); vectors are padded with zeros to m * (d/m)."""

    centers: np.ndarray
    words: np.ndarray

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest centres of each row, nearest first; of equal ones the smaller number."""
        own, step = (self.centers * self.centers).sum(axis=1), max(1, CELL_PAIRS // len(self.centers))
        near = [np.argsort(own - 2 * x[i : i + step] @ self.centers.T, axis=1, kind="stable")[:, :n].copy() for i in range(0, len(x), step)]
        return np.concatenate(near) if near else np.empty((0, n), np.int64)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """Rows x subspaces x places."""
        m, _, size = self.words.shape
        return np.pad(x, ((0, 0), (0, m * size - x.shape[1]))).reshape(len(x), m, size)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self._parts(x - self.centers[cell])
        out = np.empty(rest.shape[:2], np.uint8)
        for s, words in enumerate(self.words):
            out[:, s] = ((words * words).sum(axis=1) - 2 * rest[:, s] @ words.T).argmin(axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all words: queries x subspaces x words."""
        return np.einsum("qms,mws->qmw", self._parts(q), self.words)

    def scores(self, q: np.ndarray, tables: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Approximate inner products, queries x codes, of vectors of one cell."""
        out = np.repeat((q @ self.centers[cell])[:, None], len(codes), axis=1)
        for s in range(codes.shape[1]):
            out += tables[:, s, :][:, codes[:, s]]
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Centres of the rows of a sample, from k of them (all, if there are fewer); a centre that none is nearest to stays."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        half = (centers * centers).sum(axis=1) / 2
        at = np.concatenate([(half - x[i : i + 1024] @ centers.T).argmin(axis=1) for i in range(0, len(x), 1024)])
        n = np.bincount(at, minlength=len(centers))
        for j in range(x.shape[1]):
            centers[:, j] = np.where(n > 0, np.bincount(at, x[:, j], len(centers)) / np.maximum(n, 1), centers[:, j])
    return centers


def codewords(rest: np.ndarray, m: int, rng: np.random.Generator, most: int = 256, rounds: int = 8) -> np.ndarray:
    """m x w x size: words of each subspace of the sample's rests."""
    size = -(-rest.shape[1] // m)
    parts = np.pad(rest, ((0, 0), (0, m * size - rest.shape[1]))).reshape(len(rest), m, size)
    return np.array([k_means(parts[:, s], most, rng, rounds) for s in range(m)])


@dataclass(frozen=True)
class VectorIndex:
    """An index at `path`: `vectors` (id, unit) and `codes` (blocks of ids and codes) by cell; `probes`: cells that a query looks into, `shortlist`: candidates it compares exactly for each neighbour, both as the sample needed."""

    spark: SparkSession
    path: str
    book: Codebook
    probes: int
    shortlist: int

    @staticmethod
    def fit(vectors: DataFrame, path: str, n_cells: int | None = None, code_bytes: int = 16, sample: int = 20_000, recall: float = 0.94, seed: int = 42, id: str = "id", vector: str = "embedding") -> VectorIndex:
        """Centres and words are fitted to a sample of about `sample` vectors, a bound that doesn't grow with the table; every vector is indexed. `n_cells`: four times the root of the number of vectors, 4096 at most, if not given. The sample, compared with itself, tells how many cells and candidates it takes to find the share `recall` of the ten nearest."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id).alias("id"), _unit(F.col(vector)).alias("unit")).where("unit is not null")
        total = rows.count()
        k = n_cells or max(1, min(4096, 4 * math.isqrt(total)))
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample / max(total, 1)))).select("id", "unit")
        x = np.array([r["unit"] for r in sorted(some.collect(), key=lambda r: r["id"])], float)
        if len(x):
            rng = np.random.default_rng(seed)
            centers = k_means(x, k, rng, 12)
            home = Codebook(centers, np.zeros((1, 1, 1))).cells(x)[:, 0]
            book = Codebook(centers, codewords(x - centers[home], min(code_bytes, x.shape[1]), rng))
            probes, shortlist = _needed(book, x, recall)
        else:
            book, probes, shortlist = Codebook(np.zeros((1, 1)), np.zeros((1, 1, 1))), 1, SHORTLISTS[0]
        m, w, size = book.words.shape
        spark.createDataFrame([(book.centers.ravel().tolist(), book.centers.shape[1], book.words.ravel().tolist(), m, w, size, probes, shortlist)], "centers array<double>, dims int, words array<double>, m int, w int, size int, probes int, shortlist int").coalesce(1).write.parquet(f"{path}/book")
        index = VectorIndex(spark, path, book, probes, shortlist)
        index._place(rows, total)
        return index

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        r = spark.read.parquet(f"{path}/book").first()
        book = Codebook(np.array(r["centers"]).reshape(-1, r["dims"]), np.array(r["words"]).reshape(r["m"], r["w"], r["size"]))
        return VectorIndex(spark, path, book, r["probes"], r["shortlist"])

    def _place(self, rows: DataFrame, total: int) -> None:
        """Writes all vectors by cell, and from these files the blocks of codes."""
        book, kind = self.spark.sparkContext.broadcast(self.book), rows.schema["id"].dataType.simpleString()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1))
                    cell = book.value.cells(x)[:, 0]
                    code = pa.array([c.tobytes() for c in book.value.encode(x, cell)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1), code], ["cell", "id", "unit", "code"])

        # a cell that many vectors share is dealt to several files
        salt = F.pmod(F.xxhash64("id"), F.lit(max(1, total // FILE_ROWS)))
        out = rows.mapInArrow(placed, f"cell int, id {kind}, unit array<double>, code binary")
        out.repartition("cell", salt).sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{self.path}/vectors")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of one cell, in blocks of up to BLOCK_ROWS."""
            cell, ids, codes = None, [], []
            out = lambda: pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids], pa.list_(b.schema.field(1).type)), pa.array([b"".join(codes)], pa.binary())], ["cell", "ids", "codes"])
            for b in batches:
                for c, i, code in zip(*(x.to_pylist() for x in b.columns)):
                    if c != cell or len(ids) == BLOCK_ROWS:
                        if ids:
                            yield out()
                        cell, ids, codes = c, [], []
                    ids.append(i)
                    codes.append(code)
            if ids:
                yield out()

        if total:
            self.vectors.select("cell", "id", "code").mapInArrow(blocks, f"cell int, ids array<{kind}>, codes binary").repartition("cell", F.xxhash64("ids") % 8).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{self.path}/codes")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @cached_property
    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    def wanted(self, queries: DataFrame, probes: int | None = None, id: str = "id", vector: str = "embedding") -> DataFrame:
        """query_id, q, cells (nearest first) of the queries with a direction."""
        asked = queries.select(F.col(id).alias("query_id"), _unit(F.col(vector)).alias("q")).where("q is not null")
        book, n = self.spark.sparkContext.broadcast(self.book), probes or self.probes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = book.value.cells(_matrix(b.column(1)), n)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "q", "cells"])

        return asked.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, q array<double>, cells array<int>")

    def search(self, queries: DataFrame, n: int, probes: int | None = None, shortlist: int | None = None, id: str = "id", vector: str = "embedding") -> DataFrame:
        """query_id, id, relevance (cosine), place of about the n nearest vectors of each query, from its `probes` nearest cells; ties go to the smaller id.

        `shortlist` times n candidates are compared exactly. Queries meet a cell's blocks of codes in groups;
        each meeting hands on its best, so what is shuffled grows with queries and not with vectors. All
        cells and a shortlist of the whole table give exact neighbours.
        """
        many = n * (shortlist or self.shortlist)
        asked = self.wanted(queries, probes, id, vector)
        kind = asked.schema["query_id"].dataType.simpleString()
        if not self._any():
            return self.spark.createDataFrame([], f"query_id {kind}, id {kind}, relevance double, place long")
        each = asked.select("query_id", "q", F.explode("cells").alias("cell"))
        cells = [r["cell"] for r in each.select("cell").distinct().collect()]  # as many as there are centres, at most
        here = self.codes.where(F.col("cell").isin(cells))
        sizes = each.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
        dealt = each.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("query_id"), "groups").alias("g")).agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        met = here.join(dealt.select("cell", "qs.query_id", "qs.q"), "cell").select("cell", "ids", "codes", "query_id", "q")
        book, own = self.spark.sparkContext.broadcast(self.book), here.schema["ids"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    cell, ids, who = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(3)[i].values
                    codes = np.frombuffer(b.column(2)[i].as_py(), np.uint8).reshape(len(ids), -1)
                    q = _matrix(b.column(4)[i].values)
                    scores = book.value.scores(q, book.value.tables(q), codes, cell)
                    keep = min(many, len(ids))
                    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    rows = np.repeat(np.arange(len(q)), keep)
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(rows)), ids.take(pa.array(top.ravel())), pa.array(np.full(len(rows), cell), pa.int32()), pa.array(scores[rows, top.ravel()])], ["query_id", "id", "cell", "near"])

        rough = met.mapInArrow(run, f"query_id {kind}, id {own}, cell int, near double")
        short = rough.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))).where(F.col("r") <= many).select("query_id", "id", "cell")
        full = self.vectors.where(F.col("cell").isin(cells)).select("cell", "id", "unit")
        scored = short.join(full, ["cell", "id"]).join(asked.select("query_id", "q"), "query_id").select("query_id", "id", F.round(dot(F.col("q"), F.col("unit")), 6).alias("relevance"))
        best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
        return scored.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= n)

    def search_all(self, queries: DataFrame, n: int, id: str = "id", vector: str = "embedding") -> DataFrame:
        """As search(), but all vectors of all cells are compared as they are, so no neighbour is missed.

        Vectors and queries are dealt to blocks, and each block of one meets each of the other in a task. A
        meeting hands on its n best of each query, so what follows grows with queries times blocks, and no
        task holds more than two blocks and EXACT_PAIRS scores.
        """
        asked = queries.select(F.col(id).alias("query_id"), _unit(F.col(vector)).alias("q")).where("q is not null")
        kind = asked.schema["query_id"].dataType.simpleString()
        if not self._any():
            return self.spark.createDataFrame([], f"query_id {kind}, id {kind}, relevance double, place long")
        total = self.vectors.count()
        groups = max(1, math.ceil(asked.count() / EXACT_ROWS))
        blocks = max(math.ceil(total / EXACT_ROWS), min(math.ceil(EXACT_MEETINGS / groups), math.ceil(total / 1024)))
        deal = lambda df, key, mine, n_mine, other, n_other: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n_mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        left = deal(asked, "query_id", "g", groups, "b", blocks)
        right = deal(self.vectors.select("id", "unit"), "id", "b", blocks, "g", groups)
        own = right.schema["id"].dataType.simpleString()

        def run(some: pa.Table, rows: pa.Table) -> pa.Table:
            parts = [pa.table({"query_id": pa.array([], some.schema.field("query_id").type), "id": pa.array([], rows.schema.field("id").type), "score": pa.array([], pa.float64())})]
            if some.num_rows and rows.num_rows:
                rows = rows.sort_by("id")
                who, ids = some["query_id"].combine_chunks(), rows["id"].combine_chunks()
                q, x = _matrix(some["q"].combine_chunks()), _matrix(rows["unit"].combine_chunks()).T
                step = max(1, EXACT_PAIRS // len(ids))
                for at in range(0, len(q), step):
                    row, col, score = _best(q[at : at + step] @ x, n)
                    parts.append(pa.table({"query_id": who.take(pa.array(row + at)), "id": ids.take(pa.array(col)), "score": score}))
            return pa.concat_tables(parts)

        met = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, f"query_id {kind}, id {own}, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
        return met.select("query_id", "id", F.round("score", 6).alias("relevance")).withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= n)

    def _any(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/codes")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the n best of each row, by scores rounded to six places; ties go to the smaller column."""
    n = min(n, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, -n]
    row, col = np.nonzero(scores >= least[:, None] - 1e-6)  # all whose rounded score may be among the best
    score = scores[row, col]
    order = np.lexsort((col, -np.floor(score * 1e6 + 0.5), row))
    row, col, score = row[order], col[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[first], col[first], score[first]


def _needed(book: Codebook, x: np.ndarray, recall: float, n: int = 10, queries: int = 200) -> tuple[int, int]:
    """The fewest cells in which `queries` of the rows find the share `recall` of their n nearest among all rows, and the smallest of SHORTLISTS whose candidates lose no more than one in a hundred of these."""
    home, q = book.cells(x)[:, 0], x[:queries]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :n]
    rank = np.argsort(book.cells(q, len(book.centers)), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1
    codes, tables = book.encode(x, home), book.tables(q)
    rough = q @ book.centers[home].T
    for s in range(codes.shape[1]):
        rough += tables[:, s, :][:, codes[:, s]]
    rough[rank[:, home] >= probes] = -np.inf
    place = np.argsort(np.argsort(-rough, axis=1, kind="stable"), axis=1, kind="stable")
    found = np.take_along_axis(place, near, axis=1)
    seen = np.take_along_axis(rank, home[near], axis=1) < probes
    shortlist = next((s for s in SHORTLISTS if (found[seen] < s * n).mean() >= 0.99), SHORTLISTS[-1])
    return probes, shortlist
