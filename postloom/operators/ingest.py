"""Incremental ingestion: what is new, changed or known; state tables; watermarks; retention.

State tables are DataFrames; every change gives a new one, to be written beside the old. The same
functions serve batches and the micro-batches of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import body_hash

FLAGS = ("is_read", "is_replied", "is_flagged")


def with_keys(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds mid_hash (null for blank ids) and body_hash (null for blank bodies)."""
    mid = F.coalesce(F.col("message_id"), F.lit(""))
    return messages.withColumn("mid_hash", F.when(mid != "", F.substring(F.sha2(mid, 256), 1, 32))).withColumn("body_hash", body_hash(F.col(body)))


def classify(keyed: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds `status`: changed (known id, other flags), duplicate (known id or body) or new. An id seen with several flags counts with the largest. Rows without an id or a body are spread by the other, so that they don't meet in one task."""
    by_id = seen.where("mid_hash is not null").groupBy(F.col("mid_hash").alias("id_key")).agg(F.max(F.struct(*FLAGS)).alias("was"))
    by_body = seen.where("body_hash is not null").select(F.col("body_hash").alias("body_key"), F.lit(True).alias("known_body")).distinct()
    spread = lambda key, other: F.coalesce(key, F.concat(F.lit("none:"), F.coalesce(other, F.lit(""))))
    joined = keyed.withColumn("id_key", spread("mid_hash", "body_hash")).withColumn("body_key", spread("body_hash", "mid_hash")).join(by_id, "id_key", "left").join(by_body, "body_key", "left").drop("id_key", "body_key")
    changed = F.lit(False)
    for f in FLAGS:
        changed = changed | (F.col(f) != F.col(f"was.{f}"))
    status = F.when(F.col("was").isNotNull(), F.when(changed, "changed").otherwise("duplicate")).when(F.coalesce("known_body", F.lit(False)), "duplicate").otherwise("new")
    return joined.withColumn("status", status).drop("was", "known_body")


def first_of_each(keyed: DataFrame, order: Column) -> DataFrame:
    """Within the input: the first row of each id, then of each body; rows without the key stay."""
    columns = keyed.columns
    for key in ("mid_hash", "body_hash"):
        first = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
        keyed = first.unionByName(keyed.where(F.col(key).isNull()))
    return keyed


def mark_seen(seen: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Adds rows whose id isn't there yet (of several, the smallest by its values); rows without an id go by their body, and rows without both are added once."""
    key = F.coalesce("mid_hash", F.concat(F.lit("body:"), "body_hash"), F.lit("none"))
    new = arrivals.groupBy(key.alias("seen_key")).agg(F.min(F.struct(*seen.columns)).alias("row")).select("seen_key", "row.*")
    return seen.unionByName(new.join(seen.select(key.alias("seen_key")), "seen_key", "left_anti").select(*seen.columns))


def update_flags(table: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Overwrites flags by key, null in the news meaning no change; all rows of a key change. Of several news of a key, a flag set in any is set."""
    n = news.groupBy(key).agg(*[F.bool_or(f).alias(f"new_{f}") for f in FLAGS])
    joined = table.join(n, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in FLAGS else F.col(c) for c in table.columns])


def counters(classified: DataFrame) -> DataFrame:
    s = F.col("status")
    return classified.agg(F.count("*").alias("found"), F.count_if(s == "new").alias("added"), F.count_if(s == "duplicate").alias("skipped"), F.count_if(s == "changed").alias("updated"), F.max(F.when(s == "new", F.col("date"))).alias("newest"))


def merge_watermarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """By account: dates never go back, counts add up, folders and status are replaced."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, "account_id", "full_outer")
    return j.select("account_id", F.greatest("o.last_sync_at", "n.last_sync_at").alias("last_sync_at"), F.greatest("o.last_message_date", "n.last_message_date").alias("last_message_date"), (F.coalesce("o.messages_synced", F.lit(0)) + F.coalesce("n.messages_synced", F.lit(0))).alias("messages_synced"), F.coalesce("n.status", "o.status").alias("status"))


def since(watermark: Column, fallback: Column, hours: int = 1) -> Column:
    """Where to read from: the watermark less an overlap, if later than the fallback."""
    return F.greatest(fallback, watermark - F.expr(f"INTERVAL {hours} HOURS"))


def retain(rows: DataFrame, now: str, days: int, date: str = "date") -> DataFrame:
    """Undated rows stay."""
    return rows.where(F.col(date).isNull() | (F.col(date) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")))


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows to append: one of each key that the table lacks, the smallest by its values."""
    one = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("row")).select(key, "row.*") if len(rows.columns) > 1 else rows.distinct()
    return one.join(table.select(key), key, "left_anti").select(*rows.columns)


def close_log(events: DataFrame) -> DataFrame:
    """The state of each run: its last event."""
    return events.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("run_id", "seq")]), "seq").alias("e")).select("run_id", "e.*")


def sync_stats(accounts: DataFrame, seen: DataFrame, runs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    r = runs.agg(F.count("*").alias("total_runs"), F.coalesce(F.sum(F.when(done, F.col("messages_new"))), F.lit(0)).alias("total_new"), F.coalesce(F.sum(F.when(done, F.col("messages_skipped"))), F.lit(0)).alias("total_skipped"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(accounts, "accounts").join(one(seen, "seen")).join(r)


def two_phase(messages: DataFrame, now: str, priority_days: int, look_back_days: int) -> DataFrame:
    """What a first run stores: recent mail, then all of the look-back; one pass, each message once."""
    at = F.lit(now).cast("timestamp_ntz")
    recent = F.col("date") >= at - F.expr(f"INTERVAL {priority_days} DAYS")
    return messages.where(F.col("date") >= at - F.expr(f"INTERVAL {look_back_days} DAYS")).withColumn("phase", F.when(recent, "priority").otherwise("backfill"))


def rank_latest(rows: DataFrame, n: int, by: str, within: str | None = None) -> DataFrame:
    """The latest n rows, of each `within` if given."""
    if within is None:
        return rows.orderBy(F.desc(by)).limit(n)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(within).orderBy(F.desc(by)))).where(F.col("rn") <= n).drop("rn")
