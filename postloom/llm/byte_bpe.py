"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary gives each pre-token one slot; if the
slot's bytes equal the pre-token's, its id is found at once. Second tier, for pre-tokens that are
no token: the bytes form a linked list, and a heap of neighbouring pairs by rank yields the merges.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import Memo, map_rows, null_safe_id, small_batches
from postloom.llm.pieces import PieceEncoder

_M = (1 << 64) - 1
#: Bytes of ids that are decoded at once.
DECODE_BYTES = 1 << 20


def _hash(key: bytes) -> int:
    """64 bits of the bytes as one number, and its length."""
    x = (int.from_bytes(key, "little") % 0xFFFFFFFFFFFFFFC5 + len(key) * 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 32)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 29)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 32)


class PerfectHash:
    """Minimal perfect hash by displacement: n keys onto slots 0 to n-1. Keys fall into buckets; each bucket, largest first, gets the first displacement that sends its keys to free slots."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // load)
        grouped: list[list[tuple[bytes, int]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = _hash(k)
            grouped[h % self.buckets].append((k, h))
        self.shift, self.slots = [0] * self.buckets, [None] * n
        free = list(range(n - 1, -1, -1))
        for b in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            group = grouped[b]
            if len(group) == 1:  # any free slot does: kept as a negative number
                while self.slots[free[-1]] is not None:
                    free.pop()
                at = free.pop()
                self.slots[at], self.shift[b] = group[0][0], -at - 1
                continue
            d = 0
            while group:
                at = [self._slot(h, d) for _, h in group]
                if len(set(at)) == len(at) and all(self.slots[x] is None for x in at):
                    for (k, *_), x in zip(group, at):
                        self.slots[x] = k
                    self.shift[b] = d
                    break
                d += 1

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (h >> 31)) + d * 0x9E3779B97F4A7C15) & _M
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
        return (x ^ (x >> 31)) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 if it isn't one of the keys."""
        h = _hash(key)
        d = self.shift[h % self.buckets]
        at = -d - 1 if d < 0 else self._slot(h, d)
        return at if self.slots[at] == key else -1


# Patterns under which a single space, or a line feed, between other characters always begins a new pre-token.
CUT_AT_SPACES = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)


class ByteBPE:
    """Ranks (token bytes -> id) and the pattern that cuts pre-tokens. Under patterns other than CUT_AT_SPACES texts are taken as wholes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.hash = PerfectHash(list(ranks))
        self.slot_ids = [-1 if k is None else ranks[k] for k in self.hash.slots]
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, i in ranks.items():
            self.tokens[i] = k
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pre = Memo(self._pre_token, 10_000)
        self.pieces = PieceEncoder(lambda parts: [self.encode(p) for p in parts], self.encode, self.ranks[b"\n"], 240_000, 3 << 20) if b"\n" in ranks and pattern in CUT_AT_SPACES else None

    @staticmethod
    def load(path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pre_token(self, word: str) -> list[int]:
        raw = word.encode()
        if (at := self.hash.find(raw)) >= 0:
            return [self.slot_ids[at]]
        return self.merge(raw)

    def merge(self, raw: bytes) -> list[int]:
        """Tokens of the bytes by merging, lowest rank first, leftmost first among equals."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # by start of a part: where it ends, which is where the next starts
        before = list(range(-1, n))  # by start: where the part before starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if mid < 0 or mid >= stop or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[i], end[mid] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for w in self.pattern.findall(text):
            ids += self.pre[w]
        return array("I", ids).tobytes()

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        return list(self.pieces.rows(texts)) if self.pieces else [self.encode(t or "") for t in texts.to_pylist()]

    def decode(self, rows: list[bytes]) -> Iterator[bytes]:
        """The bytes of each row of ids: tokens' bytes gathered for many rows, or one long row's part, at once."""
        held, size = [], 0
        for r in rows:
            if size + len(r) > DECODE_BYTES:
                yield from self._gathered(held)
                held, size = [], 0
            if len(r) > DECODE_BYTES:
                yield b"".join(x for i in range(0, len(r), DECODE_BYTES) for x in self._gathered([r[i : i + DECODE_BYTES]]))
            else:
                held.append(r)
                size += len(r)
        yield from self._gathered(held)

    def _gathered(self, rows: list[bytes]) -> Iterator[bytes]:
        ids = np.frombuffer(b"".join(rows), "<u4")
        length = self.lengths[ids]
        ends = np.cumsum(length)
        out = self.flat[np.repeat(self.begins[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0] + [len(r) // 4 for r in rows])].tolist()
        return (out[a:b] for a, b in zip(cuts, cuts[1:]))


@lru_cache(4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each file and Python worker."""
    return ByteBPE.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), as ordinary text without special tokens.

    Null and empty texts have no tokens. Repeated rows and null ids are kept; an empty table gives no rows. No shuffle. `path`
    must exist on all executors.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        ids = t.encode_column(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_rows(null_safe_id(docs, doc_id, text), rows, "doc_id long, n_tokens long, ids binary")


def _decoded(t: ByteBPE, rows: list[bytes | None]) -> list[bytes | None]:
    out = t.decode([r for r in rows if r is not None])
    return [None if r is None else next(out) for r in rows]


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and `decoded` (bytes) of what encode() gives; null ids decode to null."""
    small_batches(encoded.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = _decoded(tokenizer(path, pattern), batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_rows(encoded.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), "ids"), rows, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What decode(encode(docs)) gives, made in one pass over the texts: each batch's ids are encoded, then decoded. Null and empty texts have no ids and decode to nothing (empty bytes); repeated rows and null ids are kept; an empty table gives no rows."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        ids = t.encode_column(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(_decoded(t, ids), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_rows(null_safe_id(docs, doc_id, text), rows, "doc_id long, n_tokens long, ids binary, decoded binary")
