"""How far the sources of a language differ in their words, and by which.

Words are counted by (language, source, term) in one pass over the texts. The terms of a language
are then cut in blocks, its sources too, and each task gets one tile: a dense int64 matrix of
sources by terms, in which all pairs of sources are compared by broadcasting. Partial sums of pairs
are added up, and each tile's largest terms of a source are merged. All arithmetic is
in integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import Tables, small_batches, text_slices, trim

COUNTS = "lang string, source string, term string, n long, docs long"
#: ASCII letters in lower case and all bytes beyond ASCII stay; anything else parts words.
_TERM = np.full(256, 32, np.uint8)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)

#: Rows of counts that a task holds before it adds them up, and hands them on if that doesn't help.
HELD_ROWS = 400_000
#: Sources and terms of a tile, about; a task holds two such blocks of sources at most.
SOURCES, TERMS = 256, 1024
#: Scale of a share, and what is added to each count.
SCALE_DIGITS, PRIOR = 9, 5
#: Bytes of differences that are made at once.
BROADCAST_BYTES = 16 << 20


def _counted(langs: list[str], sources: list[str], column: pa.Array) -> Iterator[pa.Table]:
    """Counts of a batch's texts; a row with an empty term and no count for each (language, source)."""
    names: dict[tuple[str, str], int] = {}
    group = np.array([names.setdefault(k, len(names)) for k in zip(langs, sources)], np.int64)
    known = list(names)
    table = lambda at, terms, n, docs: pa.table({"lang": pa.array([known[i][0] for i in at], pa.string()), "source": pa.array([known[i][1] for i in at], pa.string()), "term": terms, "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})
    yield table(range(len(known)), pa.array([""] * len(known), pa.string()), [0] * len(known), [0] * len(known))
    for row, end, data, bounds in text_slices(column, 4 << 20):
        texts = pa.LargeStringArray.from_buffers(end - row, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(_TERM[data].tobytes()))
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(end - row), np.diff(lists.offsets.to_numpy()))
        blank = terms.index("").as_py()
        if blank >= 0:
            doc, codes = doc[codes != blank], codes[codes != blank]
        if not len(codes):
            continue
        size = len(terms)
        each, times = np.unique(doc * size + codes, return_counts=True)
        pair, at = np.unique(group[row + each // size] * size + each % size, return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, times)
        groups = pa.array(pair // size)
        lang, source = (pa.array([k[i] for k in known], pa.string()).take(groups) for i in (0, 1))
        yield pa.table({"lang": lang, "source": source, "term": terms.take(pa.array(pair % size)).cast(pa.string()), "n": pa.array(n), "docs": pa.array(np.bincount(at, minlength=len(pair)).astype(np.int64))})


def _added(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (texts with the term): added up in each task, then once over a shuffle. Nulls are empty strings; each (lang, source) also has a row with an empty term and n = 0."""
    small_batches(docs.sparkSession)
    name = lambda c, to: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for t in _counted(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                held.append(t)
                rows += t.num_rows
                if rows > HELD_ROWS:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, rows = [], 0
            trim()
        if held:
            yield from _added(held).to_batches(max_chunksize=50_000)

    parts = docs.select(name(lang, "lang"), name(source, "source"), name(text, "text")).mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10**SCALE_DIGITS * (count + PRIOR) / (n + PRIOR * v)), by long division, so that no product overflows while n stays below 9e17."""
    below = np.maximum(n + PRIOR * v, 1)
    rest = count + PRIOR + np.zeros_like(below)
    out = rest // below
    rest = rest % below
    for _ in range(SCALE_DIGITS):
        rest = rest * 10
        out = out * 10 + rest // below
        rest = rest % below
    return out + 1


def pair_sums(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of |a - b| over the columns, each counted `times`, of all pairs of rows."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, BROADCAST_BYTES // max(1, 8 * b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.abs(a[i : i + step, None, :] - b[None, :, :]) @ times
    return out


_TILE = "lang string, source string, part string, item string, value long"


def _tile(most: int):
    def tile(key: tuple, t: pa.Table) -> pa.Table:
        """One block of two blocks of sources and one of terms. Rows without a term are sources; those with one are counts above 0."""
        lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
        is_source = t["term"].is_null()
        heads = t.filter(is_source).sort_by("source")
        names, block = heads["source"].to_pylist(), heads["block"].to_numpy()
        n, v, lang_n, in_block = heads["source_n"].to_numpy(), heads["v"][0].as_py(), heads["lang_n"][0].as_py(), heads["block_terms"][0].as_py()
        counts = t.filter(pc.invert(is_source))
        coded = counts["term"].combine_chunks().dictionary_encode()
        order = np.argsort(np.array([x.encode() for x in coded.dictionary.to_pylist()], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms = [coded.dictionary[int(i)].as_py() for i in order]
        column = place[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
        where = {s: i for i, s in enumerate(names)}
        row = np.fromiter((where[s] for s in counts["source"].to_pylist()), np.int64, counts.num_rows)
        dense = np.zeros((len(names), len(terms) + 1), np.int64)  # the last column stands for the block's terms that none of these sources has
        dense[row, column] = counts["n"].to_numpy()
        p = share(dense, n[:, None], v)
        times = np.ones(len(terms) + 1, np.int64)
        times[-1] = in_block - len(terms)
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        sums = pair_sums(p[a], p[b], times)
        out = [(names[i], "pair", names[j], int(sums[x, y])) for x, i in enumerate(a.tolist()) for y, j in enumerate(b.tolist()) if low != high or i < j]
        if low == high and terms:
            total = np.zeros(len(terms), np.int64)
            total[column] = counts["total"].to_numpy()
            above = p[:, :-1] - share(total, np.full(len(terms), lang_n), v)
            for i in range(len(names)):
                hits = np.flatnonzero((above[i] > 0) & (dense[i, :-1] > 0))
                best = heapq.nsmallest(most, zip((-above[i, hits]).tolist(), hits.tolist()))  # terms are in order, so ties are too
                out += [(names[i], "term", terms[k], -f) for f, k in best]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(cols[0], pa.string()), "part": pa.array(cols[1], pa.string()), "item": pa.array(cols[2], pa.string()), "value": pa.array(cols[3], pa.int64())})

    return tile


def divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, sources: int = SOURCES, terms: int = TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of each occurring (lang, source).

    Each language keeps the terms of at least `least_docs` of its texts. A source's share of a term
    is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with V kept terms and N the source's occurrences of them; the language's is q. Part `pair`: for each other
    source of the language the sum of |p - its p| over all kept terms (0 if there are none). Part `term`: the `most_terms`
    kept terms with a count and p > q that have the largest p - q. Ranks are from 1, by value descending, then
    item by bytes. Nulls in text, lang and source are empty strings; repeated rows are separate texts; an empty table gives no rows;
    a language of one source has no pairs. Pairs grow with the square of a language's sources because the result does; nothing else does.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    counts = tables.put(term_counts(docs, text, lang, source), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total")
    kept = tables.put(kept, "terms")
    heads = counts.where("term = ''").select("lang", "source")
    by_lang = heads.groupBy("lang").agg(F.ceil(F.count("*") / sources).cast("int").alias("blocks")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "lang", "left")
    by_lang = tables.put(by_lang.select("lang", "blocks", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).cast("int").alias("term_blocks")), "languages")
    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("term_block")
    source_block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    used = tables.put(counts.where("term <> ''").join(kept, ["lang", "term"]).join(by_lang, "lang").select("lang", "source", source_block, "term", term_block, "n", "total", "blocks"), "used")
    in_block = kept.join(by_lang, "lang").groupBy("lang", term_block).agg(F.count("*").alias("block_terms"))
    each = heads.join(used.groupBy("lang", "source").agg(F.sum("n").alias("source_n")), ["lang", "source"], "left").join(by_lang, "lang")
    each = each.select("lang", "source", source_block, "blocks", "v", "lang_n", F.coalesce("source_n", F.lit(0)).alias("source_n"), F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block")).join(in_block, ["lang", "term_block"], "left")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    shape = ["lang", "source", "block", "term_block", "blocks", "term", "n", "total", "source_n", "v", "lang_n", "block_terms"]
    rows = each.select("*", *none("string", "term"), *none("long", "n", "total")).withColumn("block_terms", F.coalesce("block_terms", F.lit(0))).select(*shape)
    rows = rows.unionByName(used.select("*", *none("long", "source_n", "v", "lang_n", "block_terms")).select(*shape))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    tiles = tables.put(met.groupBy("lang", "low", "high", "term_block").applyInArrow(_tile(most_terms), _TILE), "tiles")
    tables.drop("counts", "terms", "languages", "used")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    ranked = lambda part: part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = ranked(tiles.where("part = 'term'").select("lang", "source", "part", "item", "value")).where(F.col("rank") <= most_terms)
    return ranked(pairs).unionByName(best)
