"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, and union-find grouping.

Documents of equal shingle sets form a class, represented by its smallest id; only
representatives are banded. Within a bucket of representatives no list of all pairs is made:
first each is compared with the bucket's pivot; then only buckets that still hold several groups
are settled, by comparing documents of different groups by matrix products, so that what the
groups imply already is never compared again and no link between different groups is lost. There
each document is shuffled once, however many others it is compared with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import Tables, map_rows, mix, null_safe_id, words_of
from postloom.llm.components import connected_components
from postloom.llm.superminhash import bands, distinct, signatures

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Shingles of `words` words; links at `percent` similarity or more; `n_bands` bands of `band` places: at 85 % a pair shares no band with a chance of 2e-6, at 80 % 1e-4 (so lower thresholds take more bands)."""

    words: int = 3
    percent: int = 85
    band: int = 6
    n_bands: int = 28
    seed: int = 1
    #: Bytes of shingle sets that travel with the tasks at once, or that one task holds of a cloud.
    slice_bytes: int = 16 << 20


#: For five words and 80 %: a chance of 1e-6.
PROSE = Settings(words=5, percent=80, band=5, n_bands=36)


def shingles(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, owner, hash): the distinct shingle hashes of each row, sorted; owners count from the first row. A row of fewer words, but not none, has its whole sequence as its one shingle."""
    for row, end, words in words_of(column, lower=True):
        at, h = words.windows(n)
        owner = words.doc[at]
        count = np.diff(words.first)
        for short in np.flatnonzero((count > 0) & (count < n)):
            a, b = words.first[short], words.first[short + 1]
            x = np.zeros(1, _U)
            for w in words.hashes()[a:b]:
                x = mix(x ^ w, 13)
            owner, h = np.append(owner, short), np.append(h, mix(x, 17))
        yield row, end, *distinct(owner, h)


SIGNED = "doc_id long, n_shingles long, set_key binary, buckets array<long>"


def _set_keys(owner: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """What stands for each row's set: its size and two sums of mixed hashes; null for an empty set."""
    full = size > 0
    begin = (np.cumsum(size) - size)[full]
    key = np.zeros((len(size), 3), _U)
    key[:, 0] = size
    if len(h):
        with np.errstate(over="ignore"):
            for i, seed in enumerate((101, 202)):
                key[full, i + 1] = np.add.reduceat(mix(h, seed), begin)
    return [k.tobytes() if f else None for k, f in zip(key, full)]


def _sign(batch: pa.RecordBatch, s: Settings) -> pa.RecordBatch:
    sizes, keys, buckets = [], [], []
    for row, end, owner, h in shingles(batch.column(1), s.words):
        n = end - row
        size = np.bincount(owner, minlength=n)
        keys += _set_keys(owner, h, size)
        sizes.append(size)
        b = bands(signatures(owner, h, n, s.band * s.n_bands, s.seed), s.band).view(np.int64)
        buckets += [x if f else None for x, f in zip(b, size > 0)]
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "buckets"])


def _sets(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """(node, shingles) of the rows (doc_id, text, set_key, node) whose text has the set of that key."""
    sizes, hashes, keys = [], [], []
    for row, end, owner, h in shingles(batch.column(1), n):
        size = np.bincount(owner, minlength=end - row)
        keys += _set_keys(owner, h, size)
        sizes.append(size)
        hashes.append(h)
    cuts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    out = pa.RecordBatch.from_arrays([batch.column(3), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)))], ["doc_id", "shingles"])
    return out.filter(pa.array([k == w for k, w in zip(keys, batch.column(2).to_pylist())], pa.bool_()))


def _confirm(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Pairs (a, b, set of a, set of b) that reach the similarity."""
    keep = []
    for x, y in zip(batch.column(2), batch.column(3)):
        both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
        total = len(both)
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        keep.append(100 * common >= percent * (total - common))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs. Spark splits hot sides of these joins."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return map_rows(full, lambda batch: _confirm(batch, percent), "a long, b long")


def _own_words(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, lone (shingles that no other set has) of the sets that can have a link at all.

    What two sets share is shared, so a set of which less than `percent` occurs in any other set is
    linked with nothing. This is exact, and takes the far members out of groups of near copies.
    """
    each = sets.select("doc_id", F.explode("shingles").alias("h"))
    lone = each.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").groupBy("doc_id").agg(F.count("*").alias("lone"))
    sized = sets.select("doc_id", F.size("shingles").cast("long").alias("n_shingles")).join(lone, "doc_id", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    return sized.where(100 * (F.col("n_shingles") - F.col("lone")) >= percent * F.col("n_shingles"))


def _clouds(members: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, label, cloud of the documents whose links aren't settled yet: those in buckets that hold more than one group. A cloud is what such buckets connect, so no link leads out of it."""
    labelled = members.select("bucket", "doc_id").join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    labelled = tables.put(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("doc_id").alias("least")).where("low < high").select("bucket", "least")
    mixed = tables.put(mixed, "mixed")
    left = tables.put(labelled.join(mixed, "bucket"), "mixed")
    clouds = connected_components(left.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct())
    return tables.put(left.select("doc_id", "label").distinct().join(clouds.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cloud"), "doc_id"), "clouds")


#: Documents and shingles of a tile: two tiles' common shingles are counted by one matrix product.
TILE, TILE_SHINGLES = 1024, 500_000
LINK = "a long, b long"


def _across(rest: DataFrame, sets: DataFrame, percent: int, tables: Tables, slice_bytes: int) -> DataFrame:
    """Links between different groups of a cloud, enough of them to join all groups that have any.

    Every pair of groups has one that isn't its cloud's largest, so only documents of the others are
    asked about. If their sets fit in `slice_bytes` they travel with the tasks, and all documents
    are compared where they are stored. Beyond that, clouds of up to `slice_bytes` go to one task
    each, and those of more are compared with one slice of their asked documents after another.
    """
    sizes = rest.groupBy("cloud", "label").agg(F.count("*").alias("n"))
    main = tables.put(sizes.groupBy("cloud").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "main")
    marked = tables.put(rest.join(main, "cloud").select("doc_id", "label", "cloud", (F.col("label") != F.col("main")).alias("asked")), "marked")
    docs = tables.put(marked.join(sets, "doc_id").select("doc_id", "label", "cloud", "asked", "shingles", (8 * F.size("shingles") + 64).alias("bytes")), "unsettled")
    size = lambda df: int(df.where("asked").agg(F.sum("bytes")).first()[0] or 0)
    total = size(docs)
    if total <= slice_bytes:
        return _one_round(docs, docs.where("asked"), percent)
    weights = tables.put(docs.groupBy("cloud").agg(F.sum("bytes").alias("weight")), "weights")
    small = docs.join(weights.where(F.col("weight") <= slice_bytes), "cloud", "left_semi").select(*SIDE)
    found = [tables.put(small.groupBy("cloud").applyInArrow(lambda t: _links_between(t, t, percent), LINK), "found_links")]
    large = docs.join(weights.where(F.col("weight") > slice_bytes), "cloud", "left_semi")
    n = math.ceil(size(large) / slice_bytes)
    large = tables.put(large.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1)))), "large")
    for i in range(n):  # two asked documents meet in the round of the first one's slice
        found.append(tables.put(_one_round(large.where(~F.col("asked") | (F.col("slice") >= i)), large.where(F.col("asked") & (F.col("slice") == i)), percent), "found_links"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: Columns of the documents that are compared.
SIDE = ("doc_id", "label", "cloud", "shingles")


def _one_round(docs: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """Links of `docs` with `asked`, whose size the caller has checked."""
    shared = docs.sparkSession.sparkContext.broadcast(_as_bytes(asked.select(*SIDE).toArrow()))

    def links(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _links_between(pa.Table.from_batches([batch]), pa.ipc.open_stream(shared.value).read_all(), percent)
        return found.combine_chunks().to_batches()[0] if len(found) else None

    return map_rows(docs.select(*SIDE), links, LINK)


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Side:
    """Documents sorted by cloud and label."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("cloud", "ascending"), ("label", "ascending")]).combine_chunks()
        self.ids, self.label, self.cloud = (table.column(c).to_numpy() for c in SIDE[:3])
        sets = pa.concat_arrays(table.column("shingles").chunks or [pa.array([], table.schema.field("shingles").type)])
        self.flat, self.size = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def tiles(self, cloud: int) -> Iterator[tuple[int, int]]:
        a, b = np.searchsorted(self.cloud, cloud, "left"), np.searchsorted(self.cloud, cloud, "right")
        while a < b:
            end = min(b, a + TILE, max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + TILE_SHINGLES))))
            yield a, end
            a = end

    def shingles(self, a: int, b: int) -> np.ndarray:
        return self.flat[self.begin[a] : self.begin[b - 1] + self.size[b - 1]]


def _common(x: _Side, a: int, b: int, y: _Side, c: int, d: int) -> np.ndarray:
    """How many shingles each of x's documents a to b has in common with each of y's c to d."""
    both = np.concatenate([x.shingles(a, b), y.shingles(c, d)])
    row = np.repeat(np.arange(b - a + d - c), np.concatenate([x.size[a:b], y.size[c:d]]))
    _, place, count = np.unique(both, return_inverse=True, return_counts=True)
    used = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    row, place = row[keep], used[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out, width = np.zeros((b - a, d - c), np.float32), 4096
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        i, j = np.searchsorted(place, [low, low + width])
        part = np.zeros((b - a + d - c, width), np.float32)
        part[row[i:j], place[i:j] - low] = 1
        out += part[: b - a] @ part[b - a :].T
    return out.astype(np.int64)


def _links_between(one: pa.Table, other: pa.Table, percent: int) -> pa.Table:
    """Links (a of `one`, b of `other`) of documents of one cloud and different groups, as many as join their groups."""
    x, y = _Side(one), _Side(other)
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.get(v, v) != v:
            v = up[v]
        return v

    out = []
    for cloud in np.intersect1d(x.cloud, y.cloud).tolist():
        for a, b in x.tiles(cloud):
            for c, d in y.tiles(cloud):
                if x.label[a] == x.label[b - 1] == y.label[c] == y.label[d - 1]:
                    continue
                both = _common(x, a, b, y, c, d)
                linked = (100 * both >= percent * (x.size[a:b][:, None] + y.size[c:d][None, :] - both)) & (x.label[a:b][:, None] != y.label[c:d][None, :])
                for i, j in zip(*(v.tolist() for v in np.nonzero(linked))):
                    m, n = find(int(x.label[a + i])), find(int(y.label[c + j]))
                    if m != n:
                        up[max(m, n)] = min(m, n)
                        out.append((int(x.ids[a + i]), int(y.ids[c + j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


#: Nodes from here on stand for further sets of documents that have several (rows of one id with different texts).
EXTRA = (1 << 63) - (1 << 53)


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Words are lower-cased (A-Z) runs of anything but ASCII white space. Null and empty texts, and
    texts without words, have no shingles and are linked with nothing: each stays. Ids should be
    unique. Rows of one id are one document: with different texts it is linked with whatever any of
    them is linked with, and all its rows have one component and one `kept` (n_shingles is each
    row's own). A row with a null id is linked with nothing: it stays, with a null component. Ids lie
    below 2**63 - 2**53. Extra columns don't matter. An empty table gives no rows.
    """
    spark, s = docs.sparkSession, settings
    tables = Tables(spark)
    rows = null_safe_id(docs, doc_id, text)
    signed = tables.put(map_rows(rows, lambda b: _sign(b, s), SIGNED), "signed")
    named = signed.where("doc_id is not null and set_key is not null")
    several = tables.put(named.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id", "low"), "several")
    # a class's node is its least id, or a number of its own if that id has another class already
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep")).join(several.select(F.col("doc_id").alias("rep"), "low"), "rep", "left")
    own = F.lit(EXTRA) + F.pmod(F.xxhash64("set_key"), F.lit(1 << 53))
    classes = tables.put(classes.select("set_key", "rep", F.when(F.col("low") != F.col("set_key"), own).otherwise(F.col("rep")).alias("node")), "classes")
    found = classes.select(F.col("rep").alias("doc_id"), "set_key", "node")
    reps = named.join(found, ["doc_id", "set_key"]).dropDuplicates(["node"])
    placed = reps.select(F.col("node").alias("doc_id"), "n_shingles", F.explode("buckets").alias("bucket"))
    shared = tables.put(placed.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("bucket"), "shared")  # written, as below, so that Spark can split hot buckets in the join
    met = tables.put(placed.join(shared, "bucket").select("bucket", "doc_id"), "met")

    wanted = found.join(met.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    texts = rows.join(wanted, "doc_id").select("doc_id", "text", "set_key", "node")
    sets = tables.put(map_rows(texts, lambda b: _sets(b, s.words), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "sets")
    able = tables.put(_own_words(sets, s.percent), "able")
    members = met.join(able, "doc_id")
    # each bucket's pivot is the member with the least of its own: the nearest to what all share
    pivots = tables.put(members.groupBy("bucket").agg(F.min(F.struct("lone", "doc_id", "n_shingles")).alias("p"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("p.doc_id").alias("pivot"), F.col("p.n_shingles").alias("m")), "pivots")
    members = tables.put(members.join(pivots, "bucket").select("bucket", "doc_id", "n_shingles", "pivot", "m"), "members")
    tables.drop("shared", "met", "able", "pivots")
    # sizes alone rule out most pairs of very different documents
    close = lambda x, y: 100 * F.least(x, y) >= s.percent * F.greatest(x, y)

    star = members.where((F.col("doc_id") != F.col("pivot")) & close(F.col("n_shingles"), F.col("m"))).select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    known = tables.put(_same_id(named, classes, several).unionByName(_links(star, sets, s.percent)), "confirmed")
    groups = tables.put(connected_components(known), "groups")

    more = tables.put(_across(_clouds(members, groups, tables), sets, s.percent, tables, s.slice_bytes), "confirmed")
    old = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = tables.put(connected_components(old.unionByName(more)), "groups")

    found = tables.put(classes.join(groups, "node", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")), "found")
    tables.drop("classes", "several", "sets", "members", "confirmed", "groups", "labelled", "mixed", "clouds", "main", "marked", "unsettled", "weights", "large", "found_links")
    grouped = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    out = grouped.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(named: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """Links between the nodes of the sets of one document."""
    parts = named.select("doc_id", "set_key").join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("set_key", "node"), "set_key").groupBy("doc_id", "node").agg(F.lit(1).alias("x"))
    first = parts.groupBy("doc_id").agg(F.min("node").alias("b"))
    return parts.join(first, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")
