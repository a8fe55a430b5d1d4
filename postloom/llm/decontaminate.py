"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton over the items' words recognises every run of words that occurs in some item.
Streaming a document's words through it gives, at each word, the longest run ending there that
is also a run of an item; runs of `window` words (or whole shorter items) are hits.

A benchmark of up to BLOCK_BYTES travels with the tasks, and documents aren't shuffled. A larger one is
written in blocks in the shared folder. Hashes of its windows, behind a bitmap of fixed size, tell which texts
may have something in which blocks; only those are dealt by block, and a task reads one block and builds one
automaton at a time. Hashes only choose: what is a hit is what the automaton says.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import Tables, Words, map_rows, small_batches, text_slices, trim

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KEEP = bytes(b + 32 if 65 <= b <= 90 else _KEEP[b] for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised over `items` (id, words). `length`, `link`, `step` by state; `whole[state]` lists the lengths of short items that end there."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.length, self.link, self.step = [0], [-1], [{}]
        self.shortest = window
        items = [(k, w) for k, w in items if w]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.length)
        #: Items whose words pass each state when read alone; handed up to links afterwards.
        owners: list[set[str]] = [set() for _ in range(n)]
        ends: list[set[int]] = [set() for _ in range(n)]
        for k, words in items:
            state = 0
            for w in words:
                state = self.step[state][w]
                owners[state].add(k)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                at = state
                while self.length[self.link[at]] >= len(words):
                    at = self.link[at]
                ends[at].add(len(words))
        order = sorted(range(1, n), key=self.length.__getitem__, reverse=True)
        short_items: dict[tuple[int, int], set[str]] = {}
        for k, words in items:
            if len(words) < window:
                state = 0
                for w in words:
                    state = self.step[state][w]
                short_items.setdefault((state, len(words)), set()).add(k)
        self.short_items = {key: frozenset(v) for key, v in short_items.items()}
        for s in order:  # what occurs with a longer run occurs with its suffixes
            owners[self.link[s]] |= owners[s]
        self.owners = [frozenset(x) for x in owners]
        self.whole: list[tuple[int, ...]] = [()] * n
        for s in reversed(order):
            self.whole[s] = tuple(sorted(ends[s] | set(self.whole[self.link[s]])))
        self.words = set(self.step[0])

    def _extend(self, last: int, w: bytes) -> int:
        length, link, step = self.length, self.link, self.step
        if (q := step[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, w)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: bytes) -> int:
        length, link, step = self.length, self.link, self.step
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def match(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(word index, state, length of the longest run that ends there) wherever that run reaches the shortest window."""
        step, link, lengths, known, least = self.step, self.link, self.length, self.words, self.shortest
        n, floor, p = len(words), 0, least - 1
        while p < n:  # every run of `least` known words covers one of the probed positions
            if words[p] not in known:
                floor, p = p + 1, p + least
                continue
            begin, end = p, p + 1
            while begin > floor and words[begin - 1] in known:
                begin -= 1
            while end < n and words[end] in known:
                end += 1
            if end - begin >= least:
                state = size = 0
                for j in range(begin, end):
                    w = words[j]
                    while w not in step[state]:
                        state = link[state]
                        size = lengths[state]
                    state = step[state][w]
                    size += 1
                    if size >= least:
                        yield j, state, size
            floor, p = end + 1, end + least

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, merged where they touch; ids of items with a window here)."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for j, state, size in self.match(words):
            reach = 0
            if size >= self.window:
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                items |= self.owners[at]
                reach = self.window
            for n in self.whole[state]:
                if n <= size:
                    items |= self._short(words[j - n + 1 : j + 1])
                    reach = max(reach, n)
            if reach:
                begin = j - reach + 1
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, j + 1))
        return spans, items

    def _short(self, run: list[bytes]) -> frozenset[str]:
        state = 0
        for w in run:
            state = self.step[state][w]
        return self.short_items.get((state, len(run)), frozenset())


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words (and what stands between their words)."""
    if not spans:
        return text
    raw = text.encode()
    kept = raw.translate(_KEEP)
    starts, ends, i, n = [], [], 0, len(kept)
    for w in kept.split():
        i = kept.index(w, i)
        starts.append(i)
        ends.append(i := i + len(w))
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    out.append(raw[at:])
    return b"".join(out).decode()


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>, coverage double, clean_text string, dropped boolean"
#: Bytes of benchmark text that one automaton is built of (about 190 bytes of memory for each, on prose), and that travel with the tasks.
BLOCK_BYTES = 2 << 20
#: Bytes of a block whose automaton a Python worker keeps for its next tasks (about 50 MB of memory); those of larger ones are built in each task and given back.
KEPT_BYTES = 256 << 10


def _pieces(text: str, window: int, most: int) -> Iterator[str]:
    """The text; one of more than `most` bytes in parts that share window - 1 words, which have the same windows."""
    if len(text.encode()) <= most:
        yield text
        return
    words, begin = words_of(text), 0
    while True:
        end, size = begin, 0
        while end < len(words) and (size + len(words[end]) < most or end - begin < window):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[begin:end]).decode()
        if end == len(words):
            return
        begin = end - window + 1


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of both, merged where they touch."""
    if not a or not b:
        return a or b
    out: list[tuple[int, int]] = []
    for begin, end in sorted(a + b):
        if out and out[-1][1] >= begin:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


@dataclass(frozen=True)
class Items:
    """A small benchmark's items as a broadcast, or none, and then documents come with what was `found` in them, by a digest of their text."""

    shared: Broadcast | None
    found: DataFrame | None
    window: int

    def reader(self, place: int):
        """(words, spans hit, ids) of a batch's rows, for tasks; a task keeps the automaton for its next batches."""
        shared, window = self.shared, self.window

        def rows(batch: pa.RecordBatch, held: list) -> list[tuple[int, list[tuple[int, int]], set]]:
            texts = (words_of(t) for t in batch.column(place).to_pylist())
            if shared is not None:
                if not held:
                    held.append(_machine(shared, window))
                return [(len(words), *held[0].hits(words)) for words in texts]
            spans, ids = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            return [(len(words), [(x["start"], x["end"]) for x in s or []], set(i or [])) for words, s, i in zip(texts, spans, ids)]

        return rows

    def joined(self, docs: DataFrame, text: str) -> DataFrame:
        """The documents, with two more columns where the benchmark is large. Spark knows the size of what was found, and splits a text that many documents share."""
        if self.found is None:
            return docs
        names = docs.columns
        keyed = docs.withColumn("_text_key", F.sha2(F.col(f"`{text}`"), 256))
        return keyed.join(self.found.select(F.col("key").alias("_text_key"), F.col("spans").alias("_found_spans"), F.col("ids").alias("_found_ids")), "_text_key", "left").select(*[F.col(f"`{c}`") for c in names], "_found_spans", "_found_ids")


def _machine(shared: Broadcast, window: int) -> SuffixAutomaton:
    held = shared.value
    if "machine" not in held:
        made = SuffixAutomaton([(k, words_of(t)) for k, t in held["items"]], window)
        if sum(len(t.encode()) for _, t in held["items"]) > KEPT_BYTES:
            return made
        held["machine"] = made
    return held["machine"]


def _items(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int) -> Items:
    """The items, by their size. An item without an id is one with a null id."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64).alias("n")).first()["n"] or 0
    if size <= BLOCK_BYTES:
        known = [(r["id"], r["t"]) for r in rows.orderBy("id", "t").collect()]  # BLOCK_BYTES at most
        return Items(docs.sparkSession.sparkContext.broadcast({"items": known}), None, window)
    return Items(None, _found_in_blocks(docs.select(F.col(f"`{text}`").alias("t")), rows, size, window), window)


# --- benchmarks of many blocks ------------------------------------------------------------------------

#: Bits of the map of the items' windows (16 MB, sent to the driver and to tasks compressed or not), in shards.
MAP_LOG2, SHARD_LOG2 = 27, 20
#: Texts that one task scans with a block's automaton, about: the building takes some seconds.
SCANNED_BYTES = 64 << 20
_SPACED = np.frombuffer(_KEEP, np.uint8)
_FOUND = "key string, spans array<struct<start:int,end:int>>, ids array<string>"


def _windows(column: pa.Array, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of the windows of these lengths, by slices of a column; each hash once in a row."""
    for row, _, data, bounds in text_slices(column):
        words = Words(_SPACED[data], bounds, False)
        at, h = zip(*(words.windows(n) for n in lengths))
        both = np.unique(np.stack([words.doc[np.concatenate(at)].astype(np.uint64) + np.uint64(row), np.concatenate(h)], axis=1), axis=0)
        yield both[:, 0].astype(np.int64), both[:, 1]


def _item_windows(blocks: DataFrame, window: int) -> DataFrame:
    """n, h, block of the windows that items have: `window` words, or all n of a shorter item."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, block, out = batch.column(1), batch.column(0).to_numpy(), []
        sizes = np.array([len(words_of(t)) for t in texts.to_pylist()])
        for n in range(1, window + 1):
            mine = np.flatnonzero(sizes == n if n < window else sizes >= n)
            if len(mine):
                out += [(n, block[mine[r]], h) for r, h in _windows(texts.take(pa.array(mine)), (n,))]
        if not out:
            return None
        cat = np.concatenate
        return pa.RecordBatch.from_arrays([pa.array(cat([np.full(len(h), n) for n, _, h in out]), pa.int32()), pa.array(cat([h for *_, h in out]).view(np.int64)), pa.array(cat([b for _, b, _ in out]), pa.int32())], ["n", "h", "block"])

    return map_rows(blocks.select("block", "t"), rows, "n int, h long, block int").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit for each of 2**MAP_LOG2 remainders of hashes; merged by shard, so that no task and not the driver holds more than the map."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bits = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])
        for b in batches:
            shards, cells = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(shards).tolist():
                if k != shard:
                    if bits is not None:
                        yield out()
                    shard, bits = k, np.zeros(1 << SHARD_LOG2, bool)
                bits[cells[shards == k]] = True
        if bits is not None:
            yield out()

    cell = F.col("h").bitwiseAND((1 << MAP_LOG2) - 1)
    parts = windows.select(F.shiftright(cell, SHARD_LOG2).cast("int").alias("shard"), cell.bitwiseAND((1 << SHARD_LOG2) - 1).alias("cell")).distinct()
    whole = np.zeros(1 << MAP_LOG2 - 3, np.uint8)
    for r in parts.repartition(32, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary").toLocalIterator():
        whole[r["shard"] << SHARD_LOG2 - 3 :][: 1 << SHARD_LOG2 - 3] = np.frombuffer(r["bits"], np.uint8)
    return whole


def _found_in_blocks(texts: DataFrame, items: DataFrame, size: int, window: int) -> DataFrame:
    """key (SHA-256 of the text), spans and ids of the distinct texts in which items have windows."""
    spark = texts.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    n_blocks = math.ceil(1.5 * size / BLOCK_BYTES)  # dealt by hashes, so that few blocks are larger than BLOCK_BYTES

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(k, piece) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for piece in _pieces(t, window, BLOCK_BYTES // 4)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], ["id", "t"])

    pieces = map_rows(items, cut_up, "id string, t string").withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)).cast("int"))
    blocks = tables.put(pieces.repartition("block").sortWithinPartitions("block").select("block", "id", "t"), "blocks")
    windows = tables.put(_item_windows(blocks, window), "windows")
    lengths = tuple(sorted(r["n"] for r in windows.select("n").distinct().collect()))  # ten numbers at most
    schema = "key string, h long"
    if not lengths:
        return spark.createDataFrame([], _FOUND)
    bits = spark.sparkContext.broadcast(_bitmap(windows))

    def asked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, hashes, held = [], [], bits.value
        for r, h in _windows(batch.column(1), lengths):
            c = (h & np.uint64((1 << MAP_LOG2) - 1)).astype(np.int64)
            hit = held[c >> 3] >> (c & 7).astype(np.uint8) & 1 > 0
            rows.append(r[hit])
            hashes.append(h[hit])
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(hashes).view(np.int64))], ["key", "h"])

    keyed = texts.where("t is not null").select(F.sha2("t", 256).alias("key"), "t")
    met = tables.put(map_rows(keyed, asked, schema).distinct(), "met")
    pairs = tables.put(met.join(windows.select("h", "block").distinct(), "h").select("key", "block").distinct(), "pairs")
    wanted = keyed.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("t").alias("t"))  # equal keys, equal texts
    wanted = tables.put(wanted, "texts")
    loads = pairs.join(wanted.select("key", F.octet_length("t").alias("n")), "key").groupBy("block").agg(F.ceil(F.sum("n") / SCANNED_BYTES).cast("int").alias("tasks"))
    dealt = pairs.join(loads, "block").join(wanted, "key").select("block", F.pmod(F.xxhash64("key"), "tasks").alias("part"), "key", "t")
    at = next(p for p in tables.paths["blocks"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        block, machine = None, None
        for b in batches:
            out = []
            for k, key, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if k != block:
                    machine = None
                    trim()
                    mine = ds.dataset(root, filesystem=store, format="parquet").to_table(columns=["id", "t"], filter=ds.field("block") == k)
                    block, machine = k, SuffixAutomaton([(i, words_of(x)) for i, x in zip(mine["id"].to_pylist(), mine["t"].to_pylist())], window)
                spans, ids = machine.hits(words_of(t))
                if spans:
                    out.append({"key": key, "spans": [{"start": x, "end": y} for x, y in spans], "ids": list(ids)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("spans", _SPANS), ("ids", pa.list_(pa.string()))]))

    tasks = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = dealt.repartition(tasks, "block", "part").sortWithinPartitions("block").mapInArrow(scan, _FOUND)
    every = parts.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for found in batch.column(1).to_pylist():
            flat = [(x["start"], x["end"]) for x in found]
            spans.append([{"start": x, "end": y} for x, y in merged(flat[:1], flat[1:])])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), batch.column(2)], ["key", "spans", "ids"])

    out = tables.put(map_rows(every, joined, _FOUND), "found")
    tables.drop("blocks", "windows", "met", "pairs", "texts")
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def decontaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", n_chars: str = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with hit spans cut out and characters counted anew; those covered to `max_coverage` or more go. All columns stay; no shuffle. Null and empty texts have no hits and stay, as do null ids and repeated rows; an empty benchmark changes nothing."""
    small_batches(docs.sparkSession)
    items, place = _items(docs, text, benchmark, item_id, item_text, window), docs.columns.index(text)
    count, width, read = docs.columns.index(n_chars) if n_chars in docs.columns else None, len(docs.columns), items.reader(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            rows = read(batch, held)
            texts, keep = batch.column(place).to_pylist(), []
            sizes = batch.column(count).to_pylist() if count is not None else []
            for i, (t, (n, spans, _)) in enumerate(zip(texts, rows)):
                keep.append(not spans or sum(b - a for a, b in spans) < max_coverage * n)
                if spans:
                    texts[i] = cut(t, spans)
                    if sizes:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)[:width]
            columns[place] = pa.array(texts, columns[place].type)
            if sizes:
                columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))
            trim()

    return items.joined(docs, text).mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each document: words hit, items found, and the text without the hit spans.

    A document whose hit words reach `max_coverage` of its words is marked `dropped` as a whole.
    Null or empty texts and items have no words and no hits; an empty benchmark hits nothing.
    Repeated rows and null ids are kept as they are. Items without an id hit too: together they
    count as one in n_items, and are not in `items`. An empty table of documents gives no rows. A benchmark of up to
    `BLOCK_BYTES` travels with the tasks and documents aren't shuffled; of a larger one, only texts that may hold something
    of a block meet its automaton. `with_text=False` leaves clean_text null.
    """
    small_batches(docs.sparkSession)
    rows_of = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = _items(rows_of, "text", benchmark, item_id, item_text, window)
    read = known.reader(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            rows = read(batch, held)
            out = []
            for t, (n, spans, found) in zip(batch.column(1).to_pylist(), rows):
                hit = sum(b - a for a, b in spans)
                part = hit / n if n else 0.0
                out.append((n, hit, len(found), sorted(k for k in found if k is not None), [{"start": a, "end": b} for a, b in spans], part, (cut(t, spans) if t is not None else None) if with_text else None, bool(hit) and part >= max_coverage))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.float64(), pa.string(), pa.bool_()]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "coverage", "clean_text", "dropped"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    return known.joined(rows_of, "text").mapInArrow(run, SCHEMA)
