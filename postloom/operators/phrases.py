"""Phrases of a table found in texts in one pass: one Aho-Corasick automaton for each task, in place of a search for each phrase.

A phrase is found where it stands in the lower-cased text, also inside words. Tables of more than PART_BYTES go
through one automaton after another, a pass over the texts for each; a part's phrases travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases and tags of one automaton (some fifty times as much memory in a task).
PART_BYTES = 4 << 20


def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """Compiled once in each Python worker. Its values are the tags of a phrase."""
    held = shared.value
    if "machine" not in held:
        tags: dict[str, set[str]] = {}
        for phrase, tag in held.pop("phrases"):
            tags.setdefault(phrase, set()).add(tag)
        machine = ahocorasick.Automaton()
        for phrase, t in tags.items():
            machine.add_word(phrase, tuple(sorted(t)))
        if tags:
            machine.make_automaton()
        held["machine"] = machine
    return held["machine"]


def tagged(rows: DataFrame, phrases: DataFrame, key: str, text: str = "body") -> DataFrame:
    """key, tag: the distinct tags of the phrases (phrase, tag) that a row's text holds, for each row that holds any. Null texts, and null or empty phrases and null tags, match nothing; an empty table of phrases tags nothing."""
    spark = rows.sparkSession
    known = phrases.select(F.lower("phrase").alias("phrase"), F.col("tag").cast("string").alias("tag")).where("phrase <> '' and tag is not null").distinct()
    size = known.agg(F.sum(F.octet_length("phrase") + F.octet_length("tag")).alias("n")).first()["n"] or 0
    kind = rows.schema[key].dataType.simpleString()
    texts = rows.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("text"))

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = None
            for b in batches:
                machine = machine or _automaton(shared)
                at, tags = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    found = sorted({tag for _, ts in machine.iter(t) for tag in ts})
                    at += [i] * len(found)
                    tags += found
                if at:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(tags, pa.string())], [key, "tag"])

        return texts.mapInArrow(run, f"`{key}` {kind}, tag string")

    parts = -(-size // PART_BYTES)
    found = []
    for i in range(parts):
        part = known if parts == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i)
        found.append(scan(spark.sparkContext.broadcast({"phrases": [tuple(r) for r in part.collect()]})))  # about PART_BYTES
    if not found:
        return spark.createDataFrame([], f"`{key}` {kind}, tag string")
    return found[0] if parts == 1 else reduce(DataFrame.unionByName, found).distinct()
