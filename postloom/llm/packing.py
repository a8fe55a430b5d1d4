"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector (4 bits, high) and as many ids as fit in 60 bits at one width.
Ids of over 60 bits follow an escape word in full. Ids are cut in blocks; each block is one row
of a Parquet file with its place in the sequence, the documents that begin in it and their
offsets, so that blocks decode alone and in vector form.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import null_safe_id
from postloom.llm.pieces import PieceEncoder

#: Fixed values of the format: (ids in a word, bits of each) by selector; the last selector is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
_U = np.uint64


def _bits(ids: np.ndarray) -> np.ndarray:
    bits, rest = np.zeros(len(ids), np.int8), ids.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = rest >= _U(1) << _U(k)
        bits[big] += k
        rest[big] >>= _U(k)
    return bits + (rest > 0).astype(np.int8)


#: Bits of small ids.
_BITS = _bits(np.arange(1 << 18, dtype=_U))
_ZERO, _NONE = np.zeros(1, np.int32), np.zeros(0, bool)


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of a block of unsigned 64-bit ids. A word takes the most ids that fit. A single id of 31 to 60 bits, or over, takes an escape and a whole word."""
    n = len(ids)
    if not n:
        return np.zeros(0, _U)
    ids = ids.astype(_U)
    bits = _BITS[ids] if int(ids.max()) < len(_BITS) else _bits(ids)
    best = np.full(n, ESCAPE, np.int8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        wide = np.concatenate([_ZERO, np.cumsum(bits > width, dtype=np.int32)])
        fits = wide[count:] == wide[:-count] if count <= n else _NONE
        if not fits.any():  # where a narrower selector fits, this one does: none is left
            break
        best[: n - count + 1][fits] = s
    # near the end fewer ids are left than the narrow selectors take: a wider one, or escapes, serve there
    step = np.array([c for c, _ in SELECTORS] + [1])[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    chosen = best[starts]
    slots = np.ones(len(starts), np.int64) + (chosen == ESCAPE)
    at = np.concatenate([[0], np.cumsum(slots)])
    words = np.zeros(at[-1], _U)
    words[at[:-1]] = chosen.astype(_U) << _U(60)
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[at[where] + 1] = ids[starts[where]]
            continue
        count, width = SELECTORS[s]
        for j in range(count if width else 0):
            words[at[where]] |= ids[starts[where] + j] << _U(j * width)
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a block, all words of one selector at a time."""
    if not len(words):
        return np.zeros(0, _U)
    top = (words >> _U(60)).astype(np.int64)
    plain = np.ones(len(words), bool)
    if (top == ESCAPE).any():  # what follows an escape is no selector, whatever its bits
        for m in np.flatnonzero(top == ESCAPE).tolist():
            if plain[m]:
                plain[m + 1] = False
    heads = np.flatnonzero(plain)
    kinds = top[heads]
    counts = np.array([c for c, _ in SELECTORS] + [1])[kinds]
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], _U)
    for s in np.unique(kinds):
        where = np.flatnonzero(kinds == s)
        if s == ESCAPE:
            out[at[where]] = words[heads[where] + 1]
            continue
        count, width = SELECTORS[s]
        mask = _U((1 << width) - 1)
        for j in range(count if width else 0):
            out[at[where] + j] = (words[heads[where]] >> _U(j * width)) & mask
    return out


BLOCK_IDS = 1 << 16
FORMAT = "shard long, block long, first long, n_ids long, doc_ids array<long>, doc_offsets array<int>, words binary, crc long"
_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int32())), ("words", pa.binary()), ("crc", pa.int64())])
#: The shard whose first document has no id; such shards come first.
NO_ID = -(1 << 63)


def packed(ids: np.ndarray) -> bytes:
    """Words of any number of ids, little-endian, packed BLOCK_IDS at a time so that memory stays bounded."""
    return b"".join(pack(ids[i : i + BLOCK_IDS]).astype("<u8").tobytes() for i in range(0, len(ids), BLOCK_IDS))


def write_ids(docs: DataFrame, encoder: Callable[[pa.Array], Iterator[bytes]], path: str, end_id: int = 0, partitions: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes texts in ascending doc_id order (null ids first; rows of one id by text) and writes blocks of ids to `path`.

    `encoder` maps a column of texts to little-endian 32-bit ids; each document's ids end with `end_id`, so
    null and empty texts have that one. Documents are dealt out by ranges of doc_id, one shard
    for each range. A block takes whole documents until it holds BLOCK_IDS ids or more; `first`
    counts ids from the shard's start. Files are written by Spark's committer, so a lost executor
    leaves no half a shard. An empty table writes files without blocks.
    """
    rows = null_safe_id(docs, doc_id, text)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    rows = rows.repartitionByRange(n, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = None, 0, 0
        names: list[int | None] = []
        offsets: list[int] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            words = packed(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, "n_ids": held, "doc_ids": names, "doc_offsets": offsets, "words": words, "crc": zlib.crc32(words)}], schema=_ARROW)

        for batch in batches:
            for d, got in zip(batch.column(0).to_pylist(), encoder(batch.column(1))):
                if shard is None:
                    shard = NO_ID if d is None else d
                names.append(d)
                offsets.append(held)
                ids += [got, end]
                held += len(got) // 4 + 1
                if held >= BLOCK_IDS:
                    yield flush()
                    block, first, held, names, offsets, ids = block + 1, first + held, 0, [], [], []
        if names:
            yield flush()

    rows.mapInArrow(run, FORMAT).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian 32-bit) of each document, from the files.

    Sums of the shards' ids, one row for each shard (as many as the writer had partitions), give
    each shard its start. A block whose words are damaged raises an error. Documents without an id come first and keep a null id; of no blocks there are no rows.
    """
    blocks = spark.read.schema(FORMAT).parquet(path)
    bases, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        bases[r["shard"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["words"]) != r["crc"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
                ids = unpack(np.frombuffer(r["words"], "<u8")).astype("<u4")
                base, cuts = bases[r["shard"]] + r["first"], [*r["doc_offsets"], len(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([base + a for a in cuts[:-1]], pa.int64()), pa.array([b - a for a, b in zip(cuts, cuts[1:])], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


class LibraryEncoder:
    """Texts to ids with the tokenizers library; each distinct piece of text is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        line = self._encode("\n")
        if len(line) != 1 or len(self._encode("a\n b\nc")) != 3 + 2:
            raise ValueError(f"{path}: a line feed between words is no token of its own")
        self.line = line[0]
        self.pieces = PieceEncoder(self._resolve, lambda t: array("I", self._encode(t)).tobytes(), self.line)

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _resolve(self, pieces: list[str]) -> list[bytes]:
        """Many pieces in one text, with line feeds between them, at whose ids the result is cut."""
        out: list[bytes] = []
        parts = [pieces[i : i + 2000] for i in range(0, len(pieces), 2000)]
        for part, e in zip(parts, self.library.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.line).tolist()
            if len(cuts) != len(part) - 1 or any(not p or p == " " for p in part):
                out += [array("I", self._encode(p)).tobytes() for p in part]
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]
        return out

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        return self.pieces.rows(texts)


@lru_cache(2)
def library(path: str) -> LibraryEncoder:
    """One for each file and Python worker."""
    return LibraryEncoder(path)


def library_encoder(path: str) -> Callable[[pa.Array], Iterator[bytes]]:
    """An encoder for write_ids() that loads the file where it runs; `path` must exist on all executors."""
    return lambda texts: library(path)(texts)


def write_and_read(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """What read_ids() gives of the files that write_ids() makes of the documents: each with its end id, so null and empty texts have one; repeated rows and null ids are kept; an empty table gives no rows."""
    write_ids(docs, library_encoder(tokenizer), path, end_id)
    return read_ids(docs.sparkSession, path)
