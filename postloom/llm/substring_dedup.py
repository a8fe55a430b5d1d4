"""Substring dedup with a count-min prefilter.

First pass: each task counts its windows of n words in sketches of `depth` rows and hands them on
as the compressed distances between the cells it met; merged, they give a cell map of
what may repeat. Cells only ever overestimate, so a window outside the map occurs once and is done.
Second pass: windows inside the map are grouped by 96-bit hashes, which gives each its
first document. Two different windows among n meet with a chance of n * n / 2**97 (6e-4 for 10**13 windows that may repeat). Third pass: each document gets the windows that it is the first of; what else of
its windows lies inside the map has a smaller document, and goes. So only one row for each distinct
window is sent back, windows that many documents share are combined before they are shuffled, and
nothing is joined on windows.

The sketch has a fixed size, so it is the same on every machine and its merged map can travel with
the tasks. On a corpus far beyond its cells it lets more windows through, which costs shuffle and
never results; `cells_log2` is the parameter to raise then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import map_rows, null_safe_id, trim, words_of

_U = np.uint64


@dataclass(frozen=True)
class Sketch:
    """`depth` rows of 2**cells_log2 saturating cells (0, 1, more), cut in shards of 2**shard_log2 cells. The merged map takes depth * 2**cells_log2 bits at most: 128 MB as set here."""

    cells_log2: int = 29
    depth: int = 2
    shard_log2: int = 22

    def cell(self, h: np.ndarray, row: int) -> np.ndarray:
        return ((h >> _U(row * (64 - self.cells_log2))) & _U((1 << self.cells_log2) - 1)).astype(np.uint32)


_PARTS = "slot int, gaps binary"


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as their distances, from -1 on, one byte each; 255 means 255 more to go. A distance of 0 is a cell met again."""
    gap = np.diff(cells, prepend=-1)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def _cells(gaps: bytes) -> np.ndarray:
    raw = np.frombuffer(gaps, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255] - 1


class _Tally:
    """Cells met, kept as numbers until they are many, then given out by shard."""

    def __init__(self, sketch: Sketch, limit: int = 3_000_000):
        self.s, self.limit, self.held, self.n = sketch, limit, [[] for _ in range(sketch.depth)], 0

    def add(self, h: np.ndarray) -> None:
        for r, held in enumerate(self.held):
            held.append(self.s.cell(h, r))
        self.n += len(h)

    def out(self) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        size = 1 << self.s.shard_log2
        for r, held in enumerate(self.held):
            cells = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            cuts = np.searchsorted(cells, np.arange((1 << self.s.cells_log2 - self.s.shard_log2) + 1, dtype=np.int64) << self.s.shard_log2)
            slots, gaps = [], []
            for k in range(len(cuts) - 1):
                part = (cells[cuts[k] : cuts[k + 1]] & np.uint32(size - 1)).astype(np.int64)
                if len(part):
                    slots.append(r << 20 | k)
                    gaps.append(packer.compress(_gaps(part)))
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(gaps, pa.binary())], ["slot", "gaps"])
            held.clear()
        self.n = 0


def repeated_cells(docs: DataFrame, n: int, sketch: Sketch) -> dict[int, bytes]:
    """slot (row and shard) -> compressed bitmap of the cells met twice or more. What the driver gets is bounded by the sketch's size."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _Tally(sketch)
        for batch in batches:
            for _, _, words in words_of(batch.column(1)):
                t.add(words.windows(n)[1])
                if t.n >= t.limit:
                    yield from t.out()
            trim()
        if t.n:
            yield from t.out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come sorted by slot, so one slot's cells are held at a time."""
        plain, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        held, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)

        def out() -> Iterator[pa.RecordBatch]:
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([packer.compress(np.packbits(twice).tobytes())], pa.binary())], ["slot", "more"])

        for batch in batches:
            for slot, gaps in zip(batch.column(0).to_pylist(), batch.column(1)):
                if slot != held:
                    yield from out()
                    held, once, twice = slot, np.zeros(1 << sketch.shard_log2, bool), np.zeros(1 << sketch.shard_log2, bool)
                cells = _cells(plain.decompress(gaps.as_py()))
                twice[cells[once[cells]]] = True
                twice[cells[1:][cells[1:] == cells[:-1]]] = True
                once[cells] = True
        yield from out()

    parts = docs.mapInArrow(tally, _PARTS)
    tasks = min(sketch.depth << sketch.cells_log2 - sketch.shard_log2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = parts.repartition(tasks, "slot").sortWithinPartitions("slot").mapInArrow(merge, "slot int, more binary")
    return {r["slot"]: bytes(r["more"]) for r in merged.toLocalIterator()}


class CellMap:
    """The merged map, ready for look-ups. It takes the shards out of the given dict."""

    def __init__(self, shards: dict[int, bytes], sketch: Sketch):
        self.s, plain = sketch, zstandard.ZstdDecompressor()
        self.rows = [np.zeros(1 << sketch.cells_log2 - 3, np.uint8) for _ in range(sketch.depth)]
        while shards:
            slot, more = shards.popitem()
            raw = np.frombuffer(plain.decompress(more), np.uint8)
            self.rows[slot >> 20][(slot & 0xFFFFF) * len(raw) :][: len(raw)] = raw

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for r, bits in enumerate(self.rows):
            where = np.flatnonzero(out)
            c = self.s.cell(h[where], r)
            out[where] = (bits[c >> np.uint32(3)] >> (np.uint32(7) - (c & np.uint32(7))).astype(np.uint8)) & 1 > 0
        return out


def cell_map(shared: Broadcast, sketch: Sketch) -> CellMap:
    """Made of the broadcast's compressed parts when a Python worker first asks, in place of them."""
    held = shared.value
    if "map" not in held:
        held["map"] = CellMap(held.pop("parts"), sketch)
    return held["map"]


OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def _kept(words: list[bytes], hits: np.ndarray, n: int) -> list[bytes]:
    """The words that no window of n words beginning at `hits` (ascending) covers."""
    change = np.zeros(len(words) + 1, np.int32)
    change[hits] += 1
    np.add.at(change, np.minimum(hits + n, len(words)), -1)
    return [w for w, gone in zip(words, np.cumsum(change[:-1]).tolist()) if not gone]


def _among(h: np.ndarray, g: np.ndarray, known: pa.StructArray) -> np.ndarray:
    """Which of the hashes (64 and 32 bits) are among the known ones."""
    kh, kg = (c.to_numpy().view(kind) for c, kind in zip(known.flatten(), (_U, np.uint32)))
    order = np.lexsort((kg, kh))
    kh, kg = kh[order], kg[order]
    if len(kh) > 1 and (kh[1:] == kh[:-1]).any():
        both = set(zip(kh.tolist(), kg.tolist()))
        return np.array([x in both for x in zip(h.tolist(), g.tolist())], bool)
    at = np.minimum(np.searchsorted(kh, h), max(0, len(kh) - 1))
    return (kh[at] == h) & (kg[at] == g) if len(kh) else np.zeros(len(h), bool)


def dedup_substrings(docs: DataFrame, n: int = 13, sketch: Sketch = Sketch(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of n words covers it whose words also start a window in a document of a
    smaller id; what is removed never depends on other removals. Words are runs of anything but ASCII
    white space, unchanged. Null and empty texts have no words and an empty kept_text; texts under n
    words are kept whole. Rows of one id count as one document's, also with different texts: they
    take nothing from each other, and others compare with all of them. Rows with a null id are kept
    whole and take nothing from others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = null_safe_id(docs, doc_id, text)
    named = rows.where("doc_id is not null")
    shared = spark.sparkContext.broadcast({"parts": repeated_cells(named, n, sketch)})

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cells = cell_map(shared, sketch)
        ids, keys, more = [], [], []
        own = batch.column(0).to_numpy(zero_copy_only=False)
        for row, _, words in words_of(batch.column(1)):
            at, h = words.windows(n)
            hit = cells.may_repeat(h)
            at, h = at[hit], h[hit]
            if len(at):
                ids.append(own[row + words.doc[at]])
                keys.append(h)
                more.append(words.windows(n, 1)[1][hit])
        if not ids:
            return None
        cat = np.concatenate
        return pa.RecordBatch.from_arrays([pa.array(cat(keys).view(np.int64)), pa.array(cat(more).astype(np.uint32).view(np.int32)), pa.array(cat(ids), pa.int64())], ["h", "g", "doc_id"])

    firsts = map_rows(named, windows, "h long, g int, doc_id long").groupBy("h", "g").agg(F.min("doc_id").alias("k"))
    mine = firsts.groupBy("k").agg(F.collect_list(F.struct("h", "g")).alias("mine"))
    # rows without an id are spread by their texts; what a key of theirs may meet by chance isn't used
    joined = rows.withColumn("k", F.coalesce("doc_id", F.xxhash64("text"))).join(mine, "k", "left").select("doc_id", "text", "mine")

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = cell_map(shared, sketch)
        ids, mine, out = batch.column(0), batch.column(2), []
        for row, end, words in words_of(batch.column(1)):
            at, h = words.windows(n)
            hit = cells.may_repeat(h)
            at, h = at[hit], h[hit]
            g = words.windows(n, 1)[1][hit].astype(np.uint32) if len(h) else h
            cuts = np.searchsorted(words.doc[at], np.arange(end - row + 1)).tolist()
            for i, t in enumerate(batch.column(1).slice(row, end - row).to_pylist()):
                kept = all_words = (t or "").encode().split()
                a, b = cuts[i], cuts[i + 1]
                if a < b and ids[row + i].is_valid:
                    hits = at[a:b]
                    if mine[row + i].is_valid:
                        hits = hits[~_among(h[a:b], g[a:b], mine[row + i].values)]
                    if len(hits):
                        kept = _kept(all_words, hits - words.first[i], n)
                out.append((len(all_words), len(all_words) - len(kept), b" ".join(kept).decode()))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return map_rows(joined, strip, OUT)
