"""Tables under one folder: the message store, its keyword index, and what runs after an ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import analytics, chunks, ingest, keyword
from postloom.operators.daytable import DayTable
from postloom.operators.manifest import Manifest
from postloom.operators.substrings import TrigramIndex

TABLES = ("messages", "chunks", "summaries", "index", "seen", "watermarks", "runs", "cards")


class Store:
    """Versions of tables as Parquet: each write goes to a new version beside the one that is read, and becomes current when its success file is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self, table: str) -> list[int]:
        at = self._path(table)
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self.fs.exists(self._path(table, n, "_SUCCESS")))

    def read(self, table: str) -> DataFrame | None:
        found = self.versions(table)
        return self.spark.read.parquet(f"{self.root}/{table}/v{found[-1]}") if found else None

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        found = self.versions(table)
        at = f"{self.root}/{table}/v{(found[-1] + 1) if found else 0}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def days(self, table: str, rows: DataFrame | None = None, key: str = "message_id", date: str | None = "date") -> DayTable:
        """A table whose changes are written by day: the stored one, or made of `rows` where there is none (of the last version that write() left, if none are given)."""
        path = f"{self.root}/{table}"
        if Manifest(self.spark, f"{path}/versions").versions():
            return DayTable.load(self.spark, path)
        rows = self.read(table) if rows is None else rows
        if rows is None:
            raise FileNotFoundError(f"{path}: no table")
        return DayTable.create(rows, path, key, date)

    def clear(self) -> None:
        """All tables, so that nothing left behind makes a new ingestion look like a repeat."""
        for t in TABLES:
            self.fs.delete(self._path(t), True)

    def index(self) -> keyword.Index:
        """The keyword index of the chunks: the stored one, or made if there is none yet."""
        path = f"{self.root}/index"
        if Manifest(self.spark, f"{path}/versions").versions():
            return keyword.Index.load(self.spark, path)
        return keyword.Index.build(self.chunks(), path, "chunk_id")

    def chunks(self) -> DataFrame:
        """The chunks as they are, whether kept as a whole or by changes."""
        return self.days("chunks").read() if Manifest(self.spark, f"{self.root}/chunks/versions").versions() else self.read("chunks")

    def refresh_index(self) -> keyword.Index:
        """The index brought to the chunks as they are: those that have gone are removed, new ones make a segment, and segments of one size are merged. What is written follows what changed."""
        index, now = self.index(), self.chunks()
        gone = index.documents().select("doc_id").join(now.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_anti")
        return index.remove(gone).add(now, "chunk_id").compact()


def after_ingest(store: Store, now: str, retention_days: int) -> DataFrame:
    """Retention, thread summaries, keyword index, statistics (one row). Of messages and chunks (by email_id) only what goes is written: whole days leave the manifest, else keys."""
    kept = store.days("messages").retain(now, retention_days).read()
    store.write("summaries", chunks.summaries(kept))
    old = store.days("chunks", key="email_id", date=None)
    old.remove(old.read().select("email_id").distinct().join(kept.select(F.col("message_id").alias("email_id")), "email_id", "left_anti"))
    store.refresh_index()
    return analytics.mailbox_stats(kept)


def open_cascade(asked: DataFrame, messages: DataFrame, subjects: TrigramIndex) -> DataFrame:
    """ask_id, message_id: by id, else by header id, else the smallest message whose subject holds the words asked for, whatever the case. `asked`: ask_id, id, header_id, words; `subjects`: the index of subjects by message_id.

    Null and empty words find nothing. Words that several ask for are looked up once.
    """
    by_id = messages.select(F.col("message_id").alias("id"), F.col("message_id").alias("m1"))
    by_header = messages.select("header_id", F.col("message_id").alias("m2")).where("header_id is not null").groupBy("header_id").agg(F.min("m2").alias("m2"))
    first = asked.join(by_id, "id", "left").join(by_header, "header_id", "left").withColumn("found", F.coalesce("m1", "m2")).withColumn("words", F.when(F.col("found").isNull(), F.lower("words")))
    third = subjects.least(first.where("words <> ''").select("words")).withColumnRenamed("key", "m3")
    return first.join(third, "words", "left").select("ask_id", F.coalesce("found", "m3").alias("message_id"))
