"""What the operators share: shared folders, Arrow batches, and 64-bit hashes of words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the word hashing works on at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine (as in tests) one of our own. Elsewhere it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="postloom-"))
            path = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/postloom/{uuid.uuid4().hex}/{name}"


class Tables:
    """Tables of one run, written as Parquet in the shared folder and read again: cuts in the lineage that outlive executors. drop() deletes those that later ones have replaced."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch(spark, "tables"), 0
        self.paths: dict[str, list[str]] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.n}-{name}"
        self.n += 1
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but: int = 0) -> None:
        """Deletes the tables of these names but the last so many; what still reads them must have been written."""
        for name in names:
            held = self.paths.get(name, [])
            old, self.paths[name] = held[: len(held) - but], held[len(held) - but :]
            for path in old:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """One table, written and read again."""
    return Tables(df.sparkSession).put(df, name)


#: Rows in an Arrow batch at most: texts may be long, and a worker holds a few batches at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, where they are larger."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def null_safe_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only id and text, under fixed names, so that extra or clashing columns don't matter."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives memory that a Python worker has freed back to the machine; allocators keep it otherwise, and workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch at most for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None and out.num_rows:
                yield out
            out = None
            trim()

    return df.mapInArrow(run, schema)


# --- words as integers ------------------------------------------------------------------------

_U = np.uint64
#: ASCII white space: what `[\x20\x09-\x0D]` matches.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                grow = lambda b: np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U)
                up, down = grow(self.base), grow(self.inverse)
            if n > 2 * SLICE_BYTES:  # a very long text: not kept
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POWERS = [_Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)]
_BYTES = [mix(np.arange(1, 257, dtype=_U), 11), mix(np.arange(1, 257, dtype=_U), 29)]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: `doc` (row of each word, ascending), `start` and `end` (bytes, in `data`), `first` (index of each row's first word, and the end), and 64-bit hashes on demand. A null text has no words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        word = ~_SPACE[data]
        head = np.zeros(len(data) + 1, bool)
        head[bounds] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | head[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | head[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.rows = len(bounds) - 1
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        up, down = _POWERS[which].get(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_BYTES[which][self.data] * up[: len(self.data)], out=total[1:])
            return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(_U), which)

    def windows(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words of one row."""
        h, k = self.hashes(which), len(self.start) - n + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        with np.errstate(over="ignore"):
            out = np.zeros(k, _U)
            for i in range(n):
                out = out * _U(_POWERS[which].base) + h[i : i + k]
        at = np.flatnonzero(self.doc[:k] == self.doc[n - 1 :])
        return at, mix(out[at], 7 + which)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of the rows in them) of a string column, in slices of some bytes or one longer text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def words_of(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, bounds in text_slices(column):
        yield row, end, Words(data, bounds, lower)


# --- pieces of text that a byte-level pre-tokenizer never joins ---------------------------------


class Memo(dict):
    """piece -> value, computed when first met and forgotten all at once beyond `limit` entries."""

    def __init__(self, compute: Callable[[str], object], limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
