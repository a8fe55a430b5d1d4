"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import Tables

EDGES = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each node is linked to the smallest of its tree. Trees are given out and forgotten beyond a number of nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def out() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                a, b = max(a, b), min(a, b)
                parent[a] = b
                parent.setdefault(b, b)
        if len(parent) > 1_000_000:
            yield out()
            parent.clear()
    if parent:
        yield out()


def _smallest(links: DataFrame) -> DataFrame:
    """For each node its smallest neighbour; partial minima are taken before the shuffle."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of `links` (a, b) the smallest node it can reach.

    Links within a partition are first reduced to a forest by union-find. Rounds then send each
    node's larger, and next its smaller, neighbours to its smallest one, until all links lead from a
    node to its component's smallest node. Each round is written to the shared folder. Loops
    (a = b) count as isolated nodes; null ends are no links; repeated links change nothing.
    """
    tables = Tables(links.sparkSession)
    clean = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    loops = clean.where("a = b").select("a").distinct()
    edges = tables.put(clean.where("a <> b").mapInArrow(_forest, EDGES).where("a <> b").distinct(), "links")
    if edges.isEmpty():
        return loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.put(_smallest(both).select("a", F.least("a", "m").alias("m")), "least")  # written, so that Spark can split a hub's rows in the join
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.mapInArrow(_forest, EDGES).distinct()
        large = tables.put(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = tables.put(_smallest(down), "low")
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = tables.put(small, "links")
        tables.drop("least", "large", "low")
        tables.drop("links", but=1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.count_distinct("a")).first()
        if tuple(now) == before or now[0] == now[2] and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    known = labels.unionByName(roots)
    alone = loops.join(known.select(F.col("node").alias("a")), "a", "left_anti")
    return known.unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("component")))
