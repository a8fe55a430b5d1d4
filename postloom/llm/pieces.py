"""Texts as dictionary-encoded pieces that a byte-level pre-tokenizer never joins.

A single space or line feed between other characters always begins a new pre-token, and a line
feed there is one by itself. So texts are cut at such places in vector form, each distinct piece of a
batch is resolved once, and the pieces' ids are gathered back. Texts with white space of other
kinds or in runs are resolved as wholes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postloom.llm.common import text_slices

#: White space other than single spaces and line feeds.
ODD = r"[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]"


class PieceEncoder:
    """`resolve` maps pieces (a space or nothing, then no white space) to their ids; `whole` does so for any text. Ids are little-endian 32-bit integers in bytes. `break_id` is that of a line feed. About `limit` pieces are remembered: those met in the present generation, and in the one before it. Columns are taken in slices of `slice_bytes`; larger ones have fewer distinct pieces for their size, and take more memory."""

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], break_id: int, limit: int = 800_000, slice_bytes: int = 12 << 20):
        self.resolve, self.whole, self.limit, self.slice_bytes = resolve, whole, limit, slice_bytes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line = np.array([break_id], "<u4").tobytes()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """By piece, where a leading line feed is one and any other piece has lost its leading space."""
        if len(self.known) > self.limit // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        for i, x in enumerate(out):
            if x is None and (x := older.get(pieces[i])) is not None:
                out[i] = known[pieces[i]] = x
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            new = [pieces[i] for i in missing]
            breaks = [p[:1] == "\n" for p in new]
            for i, p, b, got in zip(missing, new, breaks, self.resolve([p[1:] if b else " " + p for p, b in zip(new, breaks)])):
                out[i] = known[p] = self.line + got if b else got
        return out

    def rows(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each row, in order; null counts as empty."""
        for a, b, _, _ in text_slices(column, self.slice_bytes):
            yield from self._slice(column.slice(a, b - a).cast(pa.large_string()).fill_null(""))

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", pa.large_string())), " ")
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.concatenate([[0], np.cumsum(length)])[:-1]
        store = np.frombuffer(b"".join(ids), "<u4")
        count = length[which]
        at = np.concatenate([[0], np.cumsum(count)])
        flat = store[np.repeat(begin[which] - at[:-1], count) + np.arange(at[-1])]
        cuts = at[lists.offsets.to_numpy()]
        raw = flat.tobytes()
        for i, (a, b, o) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), odd.to_pylist())):
            yield self.whole(texts[i].as_py()) if o else raw[4 * a + 4 : 4 * b]  # without the line feed put before it
