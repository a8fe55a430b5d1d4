"""Centroid clustering of integer vectors by Lloyd's rounds with Hamerly's bounds.

Each vector carries an upper bound of its distance to its own centroid and one lower bound of its
distance to every other centroid. When centroids move, the upper bound grows by the own centroid's
drift and the lower one shrinks by the largest drift of the others. While the upper bound stays
under the lower one, or under half the way from the own centroid to the nearest other one, the
vector keeps its centroid unseen. Otherwise the upper bound is replaced by the exact distance, and a
vector that is still ambiguous is compared with all centroids in integers, so that results don't
depend on the bounds. Bounds are floats that err on the safe side.

A round is one pass without a shuffle: it reads the vectors with their bounds and writes them again,
in the shared folder. Sums of centroids change by the vectors that moved; each task hands on one row
of such changes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import Tables, small_batches, trim

#: Components must lie within plus and minus this, so that squared distances of 64 of them fit in 62 bits.
LIMIT = 1 << 27
#: Factors that round a float up or down beyond all error of one operation.
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50

STATE = "vec_id long, v binary, cluster int, distance long, upper double, lower double, sums array<long>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64()), ("lower", pa.float64()), ("sums", pa.list_(pa.int64()))])


def squared(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (rows) to centroids (columns), exact."""
    out = np.empty((len(v), len(centers)), np.int64)
    for j, c in enumerate(centers):
        gap = v - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of squared distances: the nearest centroid (the smaller number of equal ones), an upper bound of its distance and a lower one of all others'."""
    at = d.argmin(axis=1)
    rows = np.arange(len(d))
    own = d[rows, at]
    rest = d.copy()
    rest[rows, at] = np.iinfo(np.int64).max
    low = np.sqrt(rest.min(axis=1).astype(np.float64)) * DOWN if d.shape[1] > 1 else np.full(len(d), np.inf)
    return at, np.sqrt(own.astype(np.float64)) * UP, low


class Bounds:
    """What a round needs of the centroids: themselves, half the way to the nearest other one, and how far they moved since the round before."""

    def __init__(self, centers: list[list[int]], before: list[list[int]] | None):
        self.centers = np.array(centers, np.int64)
        k = len(centers)
        d = squared(self.centers, self.centers)
        np.fill_diagonal(d, np.iinfo(np.int64).max)
        self.half = np.sqrt(d.min(axis=1).astype(np.float64)) * 0.5 * DOWN if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((self.centers - np.array(before, np.int64)) ** 2).sum(axis=1).astype(np.float64)) * UP
        self.drift = moved
        self.others = np.array([max([moved[j] for j in range(k) if j != i], default=0.0) for i in range(k)])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds, and how many vectors were compared with all centroids."""
        cluster, upper, lower = cluster.copy(), (upper + self.drift[cluster]) * UP, np.maximum(lower - self.others[cluster], 0.0) * DOWN
        safe = np.maximum(self.half[cluster], lower)
        doubt = np.flatnonzero(~(upper < safe))
        if len(doubt):
            gap = v[doubt] - self.centers[cluster[doubt]]
            upper[doubt] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(np.float64)) * UP
            doubt = doubt[~(upper[doubt] < safe[doubt])]
        if len(doubt):
            cluster[doubt], upper[doubt], lower[doubt] = nearest(squared(v[doubt], self.centers))
        return cluster, upper, lower, len(doubt)


@dataclass(frozen=True)
class Clusters:
    """`assigned`: vec_id, cluster, distance (squared); `centers` and `inertia` (sums of distances) by cluster; `scans`: vectors compared with all centroids, by assignment."""

    assigned: DataFrame
    centers: list[list[int]]
    inertia: list[int]
    scans: list[int]


def _changes(v: np.ndarray, old: np.ndarray | None, new: np.ndarray, sums: np.ndarray) -> None:
    """Adds the vectors that moved to the sums (components, count) of their new cluster and takes them from those of the old one."""
    moved = np.arange(len(v)) if old is None else np.flatnonzero(old != new)
    for j in range(len(sums)):
        came = moved[new[moved] == j]
        sums[j, :-1] += v[came].sum(axis=0)
        sums[j, -1] += len(came)
        if old is not None:
            went = moved[old[moved] == j]
            sums[j, :-1] -= v[went].sum(axis=0)
            sums[j, -1] -= len(went)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Clusters of the vectors with exactly `dims` components, none null or non-finite, as integers floor(scale * x).

    Centroids start as the k vectors with the smallest SHA-256 of `seed:vec_id`; each of the rounds
    assigns all vectors to their nearest centroid (ties: smaller number) and replaces every non-empty
    centroid by the floor of its vectors' mean; then vectors are assigned once more. Everything
    is exact. Other vectors are left out. With fewer than k vectors each is a centroid; an empty table gives an
    empty one. Repeated rows are separate vectors; of rows of one id the smaller vector starts first; rows without an id
    are clustered, and start last. Components beyond LIMIT raise an error. The driver holds k centroids only.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    x = F.col(f"`{vector}`")
    kept = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    kept = kept.where((F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    whole = F.transform("x", lambda c: F.floor(c * scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(order.alias("h"), whole.alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centers = [list(r["v"]) for r in first]
    if not centers:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [], [])
    if any(abs(c) >= LIMIT for row in centers for c in row):
        raise ValueError(f"components must lie within {LIMIT}")

    def step(rows: DataFrame, now: Bounds, start: bool, last: bool) -> DataFrame:
        k = len(now.centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, scans = np.zeros((k, dims + 1), np.int64), 0
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                if start:
                    real = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False) * scale)
                    if np.abs(real).max() >= LIMIT:
                        raise ValueError(f"components must lie within {LIMIT}")
                    v = real.astype(np.int64).reshape(n, dims)
                    raw = [r.tobytes() for r in v.astype("<i4")]
                    cluster, upper, lower = nearest(squared(v, now.centers))
                    old, many = None, n
                else:
                    raw = b.column(1)
                    v = np.frombuffer(b"".join(raw.to_pylist()), "<i4").astype(np.int64).reshape(n, dims)
                    old = b.column(2).to_numpy()
                    cluster, upper, lower, many = now.assign(v, old, b.column(3).to_numpy(), b.column(4).to_numpy())
                scans += many
                if not last:
                    _changes(v, old, cluster, sums)
                gap = v - now.centers[cluster] if last else None
                distance = np.einsum("ij,ij->i", gap, gap) if last else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), raw if isinstance(raw, pa.Array) else pa.array(raw, pa.binary()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.list_(pa.int64()))], schema=_ARROW)
                trim()
            yield pa.RecordBatch.from_pylist([{"sums": [*sums.ravel().tolist(), scans]}], schema=_ARROW)

        read = rows if start else rows.where("v is not null").select("vec_id", "v", "cluster", "upper", "lower")
        return tables.put(read.mapInArrow(run, STATE), "state")

    total, scans, before, state = [[0] * (dims + 1) for _ in centers], [], None, None
    for t in range(rounds + 1):
        state = step(kept if t == 0 else state, Bounds(centers, before), t == 0, t == rounds)
        tables.drop("state", but=1)
        # one row of each task, added up before it comes here; k * (dims + 1) + 1 numbers come
        told = state.where("sums is not null").select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        numbers = [int(r["n"]) for r in told.orderBy("place").collect()]
        scans.append(numbers[-1])
        if t == rounds:
            break
        before = centers
        total = [[a + b for a, b in zip(row, numbers[j * (dims + 1) :])] for j, row in enumerate(total)]
        centers = [[s // row[-1] for s in row[:-1]] if row[-1] else c for row, c in zip(total, centers)]
    assigned = state.where("v is not null").select("vec_id", "cluster", "distance")
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    return Clusters(assigned, centers, [sums.get(j, 0) for j in range(len(centers))], scans)


def centroid_digest(center: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()


def with_inertia(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. A sum that is no 64-bit number raises an error."""
    total = sum(found.inertia)
    if total >= 1 << 63:
        raise ValueError("the inertia is no 64-bit number")
    if not found.centers:
        return found.assigned.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    return found.assigned.select("vec_id", "cluster", "distance", of(found.inertia, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(map(centroid_digest, found.centers), "string").alias("centroid_sha256"))
