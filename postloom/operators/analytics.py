"""Counts over a mailbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mailbox_stats(messages: DataFrame) -> DataFrame:
    sent = F.col("direction") == "sent"
    return messages.agg(F.count("*").alias("total"), F.count_if(sent).alias("sent"), F.count_if(~sent).alias("received"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if(F.col("is_flagged")).alias("flagged"))


def volume_by_date(messages: DataFrame) -> DataFrame:
    sent = F.col("direction") == "sent"
    return messages.where("date is not null").groupBy(F.col("date").cast("date").alias("day")).agg(F.count_if(sent).alias("sent"), F.count_if(~sent).alias("received"))


def hourly(messages: DataFrame) -> DataFrame:
    """All 24 hours, with zeros."""
    spark = messages.sparkSession
    found = messages.where("date is not null").groupBy(F.hour("date").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(found, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def top(messages: DataFrame, name, n: int = 10) -> DataFrame:
    """The n commonest values, ties by name; a top-k, not a full sort."""
    return messages.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("name <> ''").orderBy(F.desc("n"), "name").limit(n)


def folders(messages: DataFrame) -> DataFrame:
    return messages.groupBy("folder").agg(F.count("*").alias("n"))


def sent_received_ratio(messages: DataFrame) -> DataFrame:
    v = volume_by_date(messages).agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
    return v.select("sent", "received", F.when(F.col("received") > 0, F.round(F.col("sent") / F.col("received"), 4)).alias("ratio"))
