"""Streams with keyed state: which messages are new, and what state a thread is in.

State of threads is held by key in RocksDB, in the query's checkpoint, so an epoch reads its own rows and
the state of their keys, however many epochs came before. What is known of messages is what earlier epochs
wrote: an epoch reads the keys and flags of these, and joins them. What an epoch gives is written under its
number; a repeated epoch overwrites its own output, and knows only epochs before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from postloom.operators import ingest
from postloom.operators.manifest import Manifest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes over when it starts."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(result: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, idle_batches: bool = True) -> None:
    """Runs until all that has arrived is done. `idle_batches`: also batches without input, in which timers of event time fire; state that ages by the clock would ask for them without end."""
    spark = result.sparkSession
    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}):
        query = result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


# --- new, changed and known messages ----------------------------------------------------------------


class _ById(StatefulProcessor):
    """Of the rows of an id in an epoch, in their order: the first of an unknown id is a candidate; the last is changed, if its flags differ from those known; all others are duplicates. One row of each end is held, so an id may have any number of rows."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "is_read boolean, is_replied boolean, is_flagged boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flags_of = lambda row: tuple(bool(row[f].iloc[0]) for f in ingest.FLAGS)
        held = lambda row, status: row.assign(status=status)
        known = tuple(self.flags.get()) if self.flags.exists() else None
        first = last = None
        for part in rows:
            if part["mid_hash"].isna().iloc[0]:
                yield part.assign(status="candidate")  # without an id there is nothing to remember
                continue
            held_rows = [] if first is None else [first] if last is first else [first, last]
            ends = pd.concat([*held_rows, part]).sort_values("place", kind="stable")
            first = ends.iloc[[0]]
            last = ends.iloc[[-1]] if len(ends) > 1 else first
            if len(ends) > 2:
                yield held(ends.iloc[1:-1], "duplicate")
        if first is None:
            return
        status = "changed" if flags_of(last) != (known or flags_of(first)) else "duplicate"
        if known is None:
            yield held(first, "candidate")
            if last is not first:
                yield held(last, status)
        else:
            if last is not first:
                yield held(first, "duplicate")
            yield held(last, status)
        self.flags.update(flags_of(last))

    def close(self) -> None:
        pass


class _ByBody(StatefulProcessor):
    """The first candidate of an unknown body is new, all others are duplicates; other rows pass."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "message_id string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            asks = (part["status"] == "candidate").to_numpy()
            if not asks.all():
                yield part[~asks]
            part = part[asks]
            if not len(part):
                continue
            if part["body_hash"].isna().iloc[0]:
                yield part.assign(status="new")
                continue
            if self.seen.exists():
                yield part.assign(status="duplicate")
                continue
            part = (part if first is None else pd.concat([first, part])).sort_values("place", kind="stable")
            first = part.iloc[[0]]
            if len(part) > 1:
                yield part.iloc[1:].assign(status="duplicate")
        if first is not None:
            self.seen.update((first["message_id"].iloc[0],))
            yield first.assign(status="new")

    def close(self) -> None:
        pass


def classified(messages: DataFrame, ttl_days: int = 365) -> DataFrame:
    """The stream's rows with `status`: new, changed or duplicate.

    Rows come in order of date, id and then all their values, so ties aren't settled by chance. An id is known once a row of it came, and a body once a
    message with it was new; both are forgotten `ttl_days` (by the clock) after they were last written. Blank ids and bodies match nothing and are
    spread by what else a row has. In contrast to a row by row check, an id counts as known also where its first row was a duplicate by body.
    """
    columns = messages.columns
    spread = lambda key, other: F.coalesce(key, F.concat(F.lit("none:"), F.coalesce(other, F.lit("")), F.lit(":"), F.xxhash64("place").cast("string")))
    place = F.concat_ws("\x1f", F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("message_id", F.lit("")), F.to_json(F.struct(*columns)))
    keyed = ingest.with_keys(messages).withColumn("place", place)
    keyed = keyed.withColumn("id_key", spread("mid_hash", "body_hash")).withColumn("body_key", spread("body_hash", "mid_hash"))
    shape = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    by_id = keyed.groupBy("id_key").transformWithStateInPandas(_ById(ttl_days * DAY_MS), f"{shape(keyed)}, status string", "Append", "ProcessingTime")
    by_body = by_id.groupBy("body_key").transformWithStateInPandas(_ByBody(ttl_days * DAY_MS), f"{shape(keyed)}, status string", "Append", "ProcessingTime")
    return by_body.select(*columns, "mid_hash", "body_hash", "status")


def classify_epoch(messages: DataFrame, ids: DataFrame, bodies: DataFrame) -> DataFrame:
    """The rows with mid_hash, body_hash, `status` and `last_of_id` (the row whose flags are its id's from now on), by the rules of classified(), as joins and windows over a whole epoch. `ids` (mid_hash, was: flags) and `bodies` (body_hash) are known. Rows that match nothing are spread by all their values."""
    columns = messages.columns
    order = [F.col("date").asc_nulls_first(), F.coalesce("message_id", F.lit("")), *[F.col(c) for c in columns if c not in ("date", "message_id")]]
    alone = F.concat(F.lit("none:"), F.xxhash64(*columns).cast("string"))
    flags = F.struct(*[F.coalesce(f, F.lit(False)).alias(f) for f in ingest.FLAGS])
    keyed = ingest.with_keys(messages).withColumn("id_key", F.coalesce("mid_hash", alone)).join(ids.select(F.col("mid_hash").alias("id_key"), "was"), "id_key", "left")
    w = Window.partitionBy("id_key").orderBy(*order)
    by_id = keyed.withColumn("nth", F.row_number().over(w)).withColumn("last_of_id", F.lead(F.lit(1)).over(w).isNull() & F.col("mid_hash").isNotNull()).withColumn("before", F.coalesce("was", F.first(flags).over(w)))
    unknown = F.col("mid_hash").isNull() | (F.col("was").isNull() & (F.col("nth") == 1))
    status = F.when(unknown, "candidate").when(F.col("last_of_id") & ~flags.eqNullSafe(F.col("before")), "changed").otherwise("duplicate")
    judged = by_id.withColumn("status", status).select(*columns, "mid_hash", "body_hash", "status", "last_of_id")
    asks = F.col("body_hash").isNotNull() & (F.col("status") == "candidate")
    met = judged.withColumn("body_key", F.when(asks, F.col("body_hash")).otherwise(alone)).join(bodies.select(F.col("body_hash").alias("body_key"), F.lit(True).alias("known")), "body_key", "left")
    first = F.row_number().over(Window.partitionBy("body_key").orderBy(*order)) == 1
    final = F.when(F.col("status") != "candidate", F.col("status")).when(asks & (F.col("known").isNotNull() | ~F.col("first")), "duplicate").otherwise("new")
    return met.withColumn("first", first).withColumn("status", final).select(*columns, "mid_hash", "body_hash", "status", "last_of_id")


def _known(spark: SparkSession, path: str, epoch: int, schema: StructType, ttl_days: int) -> tuple[DataFrame, DataFrame]:
    """(ids, bodies) that the epochs before this one wrote, less those that were last written more than `ttl_days` ago; four narrow columns are read of each row."""
    earlier = [f"{path}/{name}" for name in Manifest(spark, path).subfolders() if name.startswith("epoch=") and int(name[6:]) < epoch]
    shape = StructType([*schema.fields, *StructType.fromDDL("mid_hash string, body_hash string, last_of_id boolean, taken_at timestamp, status string, epoch long").fields])
    rows = spark.read.schema(shape).option("basePath", path).parquet(*earlier) if earlier else spark.createDataFrame([], shape)
    rows = rows.where(F.col("taken_at") >= F.current_timestamp() - F.expr(f"INTERVAL {ttl_days} DAYS"))
    flags = F.struct(*[F.coalesce(f, F.lit(False)).alias(f) for f in ingest.FLAGS])
    ids = rows.where("last_of_id").groupBy("mid_hash").agg(F.max_by(flags, "epoch").alias("was"))
    return ids, rows.where("status = 'new' and body_hash is not null").select("body_hash").distinct()


def ingest_stream(messages: DataFrame, path: str, checkpoint: str, ttl_days: int = 365) -> None:
    """Writes what has arrived under `path`, by epoch and status. An epoch is classified as a whole, against what earlier epochs wrote there, so its cost is that of a few joins and not of a call for each id; `path` goes with its checkpoint. classified() keeps the same state by key instead, for epochs of few rows."""

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        made = classify_epoch(rows, *_known(spark, path, epoch, rows.schema, ttl_days)).withColumn("taken_at", F.current_timestamp())
        made.write.mode("overwrite").partitionBy("status").parquet(f"{path}/epoch={epoch}")

    run_available(messages, write, checkpoint, idle_batches=False)


def ingested(spark: SparkSession, path: str, status: str) -> DataFrame:
    """All rows of a status, with their epoch."""
    return spark.read.option("basePath", path).parquet(path).where(F.col("status") == status)


# --- states of threads --------------------------------------------------------------------------------

_LATEST = "message_id string, ms long, mine boolean, is_replied boolean, message_count long, notes long, version long"
THREADS = "conversation_id string, message_id string, message_count long, all_notes boolean, state string, version long"


class _Thread(StatefulProcessor):
    """The latest message of a thread, and a timer that turns the thread stale once event time is more than `days` past it."""

    def __init__(self, days: int):
        self.ms = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _LATEST)

    def _row(self, key, latest: tuple, stale: bool) -> pd.DataFrame:
        message_id, _, mine, replied, count, notes, version = latest
        state = ("stale" if mine else "stale_needs_action") if stale else "awaiting_response" if mine else "completed" if replied else "needs_action"
        return pd.DataFrame([(key[0], message_id, count, notes == count, state, version)], columns=["conversation_id", "message_id", "message_count", "all_notes", "state", "version"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        message_id, ms, mine, replied, count, notes, version = self.latest.get() if self.latest.exists() else ("", -1, False, False, 0, 0, 0)
        before = ms
        for part in rows:
            count, notes = count + len(part), notes + int((part["email_type"] == "meeting_note").sum())
            part = part.sort_values(["ms", "message_id"], kind="stable")
            r = part.iloc[-1]
            if (int(r["ms"]), r["message_id"]) >= (ms, message_id):
                message_id, ms, mine, replied = r["message_id"], int(r["ms"]), bool(r["mine"]), bool(r["is_replied"])
        now = (message_id, ms, mine, replied, count, notes, version + 1)
        self.latest.update(now)
        due = ms + self.ms + 1
        if before >= 0 and before != ms:
            self.handle.deleteTimer(before + self.ms + 1)
        stale = timerValues.getCurrentWatermarkInMs() >= due
        if not stale and before != ms:
            self.handle.registerTimer(due)
        yield self._row(key, now, stale)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest = tuple(self.latest.get())
        if expiredTimerInfo.getExpiryTimeInMs() == latest[1] + self.ms + 1:
            latest = (*latest[:-1], latest[-1] + 1)
            self.latest.update(latest)
            yield self._row(key, latest, True)

    def close(self) -> None:
        pass


def thread_changes(messages: DataFrame, days: int = 14, late: str = "0 seconds") -> DataFrame:
    """A row of THREADS whenever a thread's state may have changed: on its messages, and when it turns stale, which is when event time passes its latest message by more than `days`. Messages without a conversation or date are left out; those later than `late` are dropped by the watermark. Only a thread's latest message is kept."""
    timed = messages.where("coalesce(conversation_id, '') <> '' and date is not null").select("conversation_id", F.coalesce("message_id", F.lit("")).alias("message_id"), "mine", "is_replied", "email_type", F.col("date").cast("timestamp").alias("at")).withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("conversation_id").transformWithStateInPandas(_Thread(days), THREADS, "Append", "EventTime")


def keep_thread_states(messages: DataFrame, path: str, checkpoint: str, days: int = 14, late: str = "0 seconds") -> None:
    """Writes the changes that arrivals and timers make, by epoch."""
    run_available(thread_changes(messages, days, late), lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"), checkpoint)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each thread that isn't made of notes only."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy("conversation_id").agg(F.max_by(F.struct("message_id", "message_count", "all_notes", "state"), "version").alias("l"))
    return last.select("conversation_id", "l.*").where("not all_notes").drop("all_notes")
