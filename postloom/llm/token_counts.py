"""Token counts by a finite-state transducer compiled from a BPE tokenizer file.

A sequence of tokens is what BPE makes of a text exactly if each neighbouring pair is what BPE
makes of that pair. So tokenization is an unambiguous non-deterministic automaton over symbols
whose states are (token in progress, token before it). Determinizing it gives states that are
small sets of such pairs, each with the number of tokens it has cost beyond the cheapest; a
transition carries the tokens emitted. States and transitions are compiled when first taken and
kept within a bound.

Counting over chunks: the symbols of a text (bytes, and bytes that end a word) are cut in chunks of
a fixed number, wherever that falls. A chunk's map is a function of any state the machine may be in before
it, to the state after it and the tokens emitted between, and is made of the chunk alone: the bytes of the word that
was begun before (run from the given state), and, if a word ends here, the tokens after that and the state
that is left, which no longer depend on what came before. Maps compose associatively: the end of one meets the
head of the next. A prefix scan over them counts a text of any length. Words that lie wholly inside a chunk
start and end at the start state: their maps are numbers, which are remembered (a cache of the machine's results).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from postloom.llm.common import Memo, map_rows, null_safe_id, text_slices


#: Lower-case mappings of Unicode 16 that Python's tables may lack.
LATER_LOWER = {0xA7CB: 0x0264, 0xA7DC: 0x019B}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """BPE over symbols: the ranks of pairs, and tokens as strings."""

    def __init__(self, merges: Sequence[Sequence[str]]):
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.tokens = {a + b for a, b in self.rank}

    def split(self, symbols: Sequence[str]) -> list[str]:
        parts = list(symbols)
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            pair, i, out = (parts[best[1]], parts[best[1] + 1]), 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


#: The state at the start of a word: no token in progress, none before it, no cost.
START = ((0, None, 0),)


class CountTransducer:
    """word -> number of tokens. Symbols are byte characters; the last one carries `end`."""

    def __init__(self, merges: Sequence[Sequence[str]], end: str, limit: int = 200_000):
        self.bpe, self.end, self.limit = Merges(merges), end, limit
        letters = byte_symbols()
        self.letters = letters
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[tuple[str, ...] | None] = [None]
        for symbols in [(c,) for c in letters] + [(c + end,) for c in letters] + [self._symbols(t) for t in self.bpe.tokens]:
            node = 0
            for s in symbols:
                node = self.trie[node].setdefault(s, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
                    self.token.append(None)
            if self.bpe.split(symbols) == ["".join(symbols)]:  # reachable by its own merges
                self.token[node] = symbols
        self.follows = lru_cache(500_000)(self._follows)
        self.reset()

    def _symbols(self, token: str) -> tuple[str, ...]:
        body = token.removesuffix(self.end) if self.end and token.endswith(self.end) and token != self.end else token
        last = token[len(body) :]
        return (*body[:-1], body[-1] + last)

    def _follows(self, a: tuple[str, ...] | None, b: tuple[str, ...]) -> bool:
        return a is None or self.bpe.split(a + b) == ["".join(a), "".join(b)]

    def reset(self) -> None:
        self.ids = {START: 0}
        self.sets = [START]
        #: By state: symbol -> (next state, tokens emitted); a final symbol leads to no state.
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        final = len(symbol) > 1
        items, done = [], None
        for node, before, cost in self.sets[state]:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            if self.trie[child] and not final:
                items.append((child, before, cost))
            t = self.token[child]
            if t is not None and self.follows(before, t):
                done = (t, cost + 1)  # one token at most can end here
        if final:
            arc = (-1, done[1])
        else:
            if done:
                items.append((0, done[0], done[1]))
            least = min(c for *_, c in items)
            key = tuple(sorted(((n, b, c - least) for n, b, c in items), key=lambda x: (x[0], x[2])))
            arc = (self._id(key), least)
        self.arcs[state][symbol] = arc
        return arc

    def _id(self, key: tuple) -> int:
        """The number of a state that may have been forgotten since."""
        if (state := self.ids.get(key)) is None:
            state = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.arcs.append({})
        return state

    def run(self, key: tuple, raw: bytes, ends: bool) -> tuple[tuple, int]:
        """(state, tokens emitted) after the bytes, from the state `key`; `ends` if a word ends with them."""
        state, total = self._id(key), 0
        symbols = [self.letters[b] for b in raw]
        if ends and symbols:
            symbols[-1] += self.end
        for s in symbols:
            if (arc := self.arcs[state].get(s)) is None:
                if len(self.sets) > self.limit:
                    key = self.sets[state]
                    self.reset()
                    state = self._id(key)
                arc = self._compile(state, s)
            state = max(arc[0], 0)
            total += arc[1]
        return self.sets[state], total

    def count(self, word: bytes) -> int:
        return self.run(START, word, True)[1]


@dataclass
class Chunk:
    """Symbols of a text: bytes of a word that began before (`head`, if `cut`), tokens of the words that begin and end here (`inner`), and bytes of a word that goes on (`tail`). `ended`: a word ends here; else all bytes are in `head`."""

    head: bytes = b""
    inner: int = 0
    tail: bytes = b""
    ended: bool = False
    cut: bool = False


@dataclass(frozen=True)
class ChunkMap:
    """state -> (state, tokens): `head` is run from the state before; if a word ends (`ended`), `tokens` more follow and `state` is left, whatever came before."""

    head: bytes = b""
    ended: bool = False
    tokens: int = 0
    state: tuple = START


class Counter:
    """Tokens of white-space-free stretches and of whole texts, for a tokenizer file with NFC, lower-casing, a splitting pattern and byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a tokenizer of the kind compiled here")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.machine = CountTransducer(merges, spec["model"]["end_of_word_suffix"] or "")
        self.words = Memo(self.machine.count, 100_000)
        self.stretches = Memo(self._stretch)

    def pre_tokens(self, text: str) -> Iterator[bytes | None]:
        """The words of a text without white space, and None for each added token in it."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield from self._words(text[at : m.start()])
            yield None
            at = m.end()
        yield from self._words(text[at:])

    def _words(self, text: str) -> Iterator[bytes]:
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if not text.isascii():
            text = text.translate(LATER_LOWER)
        return map(str.encode, self.pattern.findall(text))

    def _stretch(self, raw: bytes) -> int:
        """Symbols << 32 | tokens."""
        return sum(1 << 32 | 1 if w is None else len(w) << 32 | self.words[w] for w in self.pre_tokens(raw.decode()))

    # --- state maps of chunks -----------------------------------------------------------------

    def chunks(self, raw: bytes, size: int) -> Iterator[Chunk]:
        """The text's symbols, `size` to a chunk."""
        chunk, room = Chunk(), size
        for stretch in raw.split():
            if (chunk.ended or not chunk.cut) and len(stretch) < 256:  # most lie inside the chunk as a whole
                both = self.stretches[stretch]
                if 0 < both >> 32 < room:
                    chunk.inner += both & 0xFFFFFFFF
                    chunk.ended = True
                    room -= both >> 32
                    continue
            for w in self.pre_tokens(stretch.decode()):
                if w is None:  # an added token is one symbol, between words
                    chunk.ended = True
                    chunk.inner += 1
                    room -= 1
                else:
                    while len(w) > room:
                        if chunk.ended:
                            chunk.tail = w[:room]
                        else:
                            chunk.head += w[:room]
                        yield chunk
                        chunk, w, room = Chunk(), w[room:], size
                        chunk.cut = True
                    room -= len(w)
                    if chunk.ended or not chunk.cut:
                        chunk.inner += self.words[w]
                    else:
                        chunk.head = w
                    chunk.ended = True
                if not room:
                    yield chunk
                    chunk, room = Chunk(), size
        yield chunk

    def chunk_map(self, c: Chunk) -> ChunkMap:
        """Of the chunk alone: maps may be made in any order, or all at once."""
        if not c.ended:
            return ChunkMap(c.head, False)
        state, n = self.machine.run(START, c.tail, False) if c.tail else (START, 0)
        return ChunkMap(c.head, True, c.inner + n, state)

    def apply(self, m: ChunkMap, state: tuple) -> tuple[tuple, int]:
        """(state after, tokens emitted) from any state."""
        after, n = self.machine.run(state, m.head, m.ended) if m.head else (state, 0)
        return (m.state, n + m.tokens) if m.ended else (after, n)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbours."""
        if not a.ended:
            return ChunkMap(a.head + b.head, b.ended, b.tokens, b.state)
        state, n = self.apply(b, a.state)
        return ChunkMap(a.head, True, a.tokens + n, state)

    def column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; each distinct stretch of the column is looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        each = np.fromiter((self.stretches[x.encode()] & 0xFFFFFFFF if x else 0 for x in coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        return np.diff(total[lists.offsets.to_numpy()])

    def count(self, raw: bytes, chunk_bytes: int) -> int:
        return self.apply(scan([self.chunk_map(c) for c in self.chunks(raw, chunk_bytes)], self.compose)[-1], START)[1]


def scan(items: list, compose: Callable) -> list:
    """Inclusive prefix scan by doubling: each round composes disjoint neighbours, so a round's compositions could all run at once."""
    out, step = list(items), 1
    while step < len(out):
        for i in range(2 * step - 1, len(out), 2 * step):
            out[i] = compose(out[i - step], out[i])
        step *= 2
    while step > 1:
        step //= 2
        for i in range(3 * step - 1, len(out), 2 * step):
            out[i] = compose(out[i - step], out[i])
    return out


SLICE = 12 << 20
#: Symbols of a chunk.
CHUNK_BYTES = 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled counter for each file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: UTF-8 bytes and tokens, without begin and end tokens.

    Strings of added tokens inside a text count as one token each. Null and empty texts: 0 bytes,
    0 tokens. Repeated rows and null ids are kept; an empty table gives no rows. A text is cut in chunks of `chunk_bytes` symbols,
    whose state maps are composed; one of a single chunk is the sum of its words. No shuffle.
    `path` must exist on all executors.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        sizes, counts = [], []
        for a, b, _, bounds in text_slices(batch.column(1), SLICE):
            texts = batch.column(1).slice(a, b - a).cast(pa.large_string()).fill_null("")
            size = np.diff(bounds)
            long = size > chunk_bytes
            n = c.column(pc.if_else(pa.array(long), pa.scalar("", pa.large_string()), texts))
            for i in np.flatnonzero(long):
                n[i] = c.count(texts[i].as_py().encode(), chunk_bytes)
            sizes.append(size)
            counts.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return map_rows(null_safe_id(docs, doc_id, text), rows, SCHEMA)
