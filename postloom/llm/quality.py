"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

A text that compresses far better than prose of its length repeats itself; one that hardly
compresses is noise. Bands are length-specific because a compressor needs some text before it
finds repeats. Chunks find a repetitive or random stretch inside a long, otherwise normal text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from postloom.llm.common import map_rows, null_safe_id, small_batches


@dataclass(frozen=True)
class Bands:
    """`whole` and `chunk`: (bytes below which the row holds, lowest ratio, highest ratio), ascending; ratio is plain bytes by compressed bytes. The upper bounds lie well outside what prose reaches at these lengths (about 0.3 to 2 below 256 bytes, 1.3 to 3 beyond). The lower bounds lie between prose in alphabetic scripts (1.34 or more from 256 bytes, 1.43 from 512, 1.69 from 1024, 2.05 from 4096 and in chunks) and base64 or random words of letters and digits (at most 1.25, 1.32, 1.38 and 1.40)."""

    whole: tuple[tuple[float, float, float], ...] = ((64, 0.0, 2.5), (256, 0.75, 2.75), (512, 1.28, 3.25), (1024, 1.36, 3.25), (4096, 1.45, 3.5), (16384, 1.6, 4.0), (float("inf"), 1.6, 5.0))
    chunk: tuple[float, float] = (1.6, 4.5)
    chunk_bytes: int = 4096
    level: int = 3


def ratio(raw: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(raw) / len(packer.compress(raw)) if raw else 0.0


def verdict(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, float, str]:
    """(ratio of the whole, lowest and highest ratio of chunks, reason: '' if inside all bands). Chunks are full; the last one is aligned to the end of the text, so that no byte is outside all chunks. A text of one chunk at most is judged as a whole only."""
    whole = ratio(raw, packer)
    low, high = next((lo, hi) for below, lo, hi in bands.whole if len(raw) < below)
    n = bands.chunk_bytes
    starts = [*range(0, len(raw) - n + 1, n), *([len(raw) - n] if len(raw) % n else [])] if len(raw) > n else []
    parts = [ratio(raw[i : i + n], packer) for i in starts]
    least, most = (min(parts), max(parts)) if parts else (whole, whole)
    reason = ""
    if whole > high:
        reason = "repetitive"
    elif whole < low:
        reason = "incompressible"
    elif parts and most > bands.chunk[1]:
        reason = "repetitive_chunk"
    elif parts and least < bands.chunk[0]:
        reason = "incompressible_chunk"
    return whole, least, most, reason


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(covered, i)
            covered = i + 3
    return n


_SPACES = bytes([9, 10, 11, 12, 13, 32])
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunk_low double, chunk_high double, reason string, kept boolean"


def measure(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    whole, low, high, reason = verdict(raw, bands, packer)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, whole, low, high, reason, not failed and not reason


def quality(docs: DataFrame, bands: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: base counts, compression ratios, reason and `kept`.

    A document fails at the base if it has under 50 words, or if more than half of its words lie in
    3-word windows that occur twice or more. Else it is kept if all ratios lie inside their bands.
    Null and empty text: no words, base_failed, not kept. Null ids stay null. Repeated rows are
    judged separately. Texts of any length are read whole. No shuffle. An empty table gives no rows.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=bands.level)
        out = [measure(t, bands, packer) for t in batch.column(1).to_pylist()]
        columns = list(zip(*out))
        kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.string(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return map_rows(null_safe_id(docs, doc_id, text), rows, SCHEMA)


def kept_documents(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; no shuffle and no join. Null and empty texts go; null ids and repeated rows stay if their texts do; an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=bands.level)
        return batch.filter(pa.array([measure(t, bands, packer)[-1] for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_rows(docs, rows, docs.schema)
