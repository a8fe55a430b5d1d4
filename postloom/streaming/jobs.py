"""Streams: the batch operators over files that arrive, with watermarks and state tables.

Each job runs with availableNow: it takes what has arrived since the last run's checkpoint, and
stops. Sinks are written by epoch, so a repeated epoch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def daily_volume(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "1 hour") -> DataFrame:
    """day, key, n over tumbling days; rows later than `late` are dropped in append mode."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day"), key).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), key, "n")


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row of each key within the watermark's horizon."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Appends to Parquet until all that has arrived is done; or for update mode writes what each epoch changed under epoch=n, for latest() to read, or for complete mode overwrites."""
    if mode == "update":
        query = result.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/epoch={n}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    elif mode == "append":
        query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = result.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last row of each key that an update job wrote."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("row")).select(*keys, "row.*")
