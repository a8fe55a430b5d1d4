"""Daily partial aggregates of a mailbox that add up: counts exactly, distinct threads by mergeable sketches beside exact sets.

Each batch of messages writes its own rows, by day; a range of days is the sum of the rows in it, so
nothing is counted again when messages come. Rows of a (day, hour, folder, name) are few whatever the number of messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.manifest import Manifest

#: Logarithm of a sketch's nominal entries: an error of about 1.6 % (one standard deviation) at 12.
SKETCH_LOG2 = 12


def partial(messages: DataFrame) -> DataFrame:
    """day, hour (null for undated), folder, counts, and a sketch of thread ids, of one batch."""
    sent = F.col("direction") == "sent"
    thread = F.nullif("conversation_id", F.lit(""))
    return messages.groupBy(F.col("date").cast("date").alias("day"), F.hour("date").alias("hour"), "folder").agg(F.count("*").alias("total"), F.count_if(sent).alias("sent"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("is_flagged").alias("flagged"), F.theta_sketch_agg(thread, SKETCH_LOG2).alias("threads"))


def names(messages: DataFrame) -> DataFrame:
    """day, kind (sender or recipient), name, n of one batch: who wrote to me, and whom I wrote to."""
    name = F.coalesce(F.nullif("sender_name", F.lit("")), "sender")
    received = messages.where("direction = 'received'").select("date", F.lit("sender").alias("kind"), name.alias("name"))
    wrote = messages.where("direction = 'sent'").select("date", F.lit("recipient").alias("kind"), F.explode("recipients").alias("name"))
    both = received.unionByName(wrote.withColumn("name", F.trim("name")))
    return both.where("name <> ''").groupBy(F.col("date").cast("date").alias("day"), "kind", "name").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Rollups:
    """The parts under `path` that the manifest's latest version names."""

    spark: SparkSession
    path: str

    def _manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.path.rstrip('/')}/versions")

    def add(self, messages: DataFrame, batch: str) -> bool:
        """Adds a batch of messages that aren't in it yet (message_id, conversation_id, date, direction, is_read, is_flagged, folder, sender, sender_name, recipients). A batch whose name is there already is left out, so a repeated run counts nothing twice."""
        at, held = self._manifest().read()
        parts = held.get("parts", [])
        if batch in parts:
            return False
        for name, rows in (("days", partial(messages)), ("names", names(messages)), ("threads", messages.where("coalesce(conversation_id, '') <> ''").select(F.col("date").cast("date").alias("day"), "conversation_id").distinct())):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        self._manifest().commit(at, {"parts": [*parts, batch]})
        return True

    def _read(self, name: str, where: Column | None) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{name}/{p}" for p in self._manifest().read()[1]["parts"]])
        return rows if where is None else rows.where(where)

    def stats(self, where: Column | None = None) -> DataFrame:
        """One row: total, sent, received, unread, flagged of the days that `where` (on day) leaves."""
        of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return self._read("days", where).agg(of("total"), of("sent"), of("unread"), of("flagged")).select("total", "sent", (F.col("total") - F.col("sent")).alias("received"), "unread", "flagged")

    def volume(self, where: Column | None = None) -> DataFrame:
        rows = self._read("days", where).where("day is not null")
        return rows.groupBy("day").agg(F.sum("sent").alias("sent"), F.sum(F.col("total") - F.col("sent")).alias("received"))

    def hourly(self, where: Column | None = None) -> DataFrame:
        found = self._read("days", where).where("hour is not null").groupBy(F.col("hour").cast("long").alias("hour")).agg(F.sum("total").alias("n"))
        return self.spark.range(24).withColumnRenamed("id", "hour").join(found, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))

    def folders(self, where: Column | None = None) -> DataFrame:
        return self._read("days", where).groupBy("folder").agg(F.sum("total").alias("n"))

    def top(self, kind: str, n: int = 10, where: Column | None = None) -> DataFrame:
        return self._read("names", where).where(F.col("kind") == kind).groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(n)

    def threads(self, where: Column | None = None, exact: bool = True) -> DataFrame:
        """One row, n: distinct threads. Exactly, from each batch's distinct (day, thread); or about, by uniting the sketches, whose number doesn't follow the number of threads."""
        if exact:
            return self._read("threads", where).agg(F.count_distinct("conversation_id").alias("n"))
        return self._read("days", where).agg(F.theta_sketch_estimate(F.theta_union_agg("threads", SKETCH_LOG2)).alias("n"))
