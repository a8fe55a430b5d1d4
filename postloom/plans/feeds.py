"""Queries on streams and mail files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.plans.views import messages, table
from postloom.sources import mailbox_stream, rfc822
from postloom.streaming import jobs, stateful


def _place(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, which is the checkpoint folder. On one machine the warehouse does where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/postloom/{uuid.uuid4().hex}/{name}"


def _streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = _place(spark, "arrivals")
    df.write.parquet(path)
    return jobs.file_stream(spark, path, df.schema)


def _written_as(rows: DataFrame, path: str, files: int) -> None:
    """Writes rows as just so many files, by message; where there are fewer messages than files, some are empty."""
    spark = rows.sparkSession
    rows.repartition(files, "message_id").write.parquet(path)
    for _ in range(files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
        spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)


def _deliver(mail: DataFrame, box: str) -> None:
    """Adds messages to the folders of their accounts."""
    for (account,) in mail.select("account").distinct().orderBy("account").collect():  # a handful of mailboxes
        mail.where(F.col("account") == account).drop("account").write.mode("append").parquet(f"{box}/{account}")


def stream_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _place(spark, "volume")
    jobs.run_once(jobs.daily_volume(_streamed(spark, table(spark, sf_dir, "events"))), out, _place(spark, "checkpoint"), "update")
    return jobs.latest(spark, out, "day", "event_type")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _place(spark, "first")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    jobs.run_once(jobs.first_seen(_streamed(spark, events.unionByName(events)), "event_id"), out, _place(spark, "checkpoint"))
    return spark.read.schema("event_id long, user_id long").parquet(out).select("event_id", "user_id")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages twice, in two runs from one checkpoint: what was new. The second run finds nothing."""
    out, at = _place(spark, "ingested"), _place(spark, "checkpoint")
    m = messages(spark, sf_dir)
    arrivals = _place(spark, "arrivals")
    m.write.parquet(f"{arrivals}/first")
    stream = spark.readStream.schema(m.schema).option("recursiveFileLookup", "true").parquet(arrivals)
    stateful.ingest_stream(stream, out, at)
    spark.read.schema(m.schema).parquet(f"{arrivals}/first").write.parquet(f"{arrivals}/second")
    stateful.ingest_stream(stream, out, at)
    return stateful.ingested(spark, out, "new").select("message_id")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent messages, and then all with the flags of some turned over: the status of each row that came second."""
    out, at, arrivals = _place(spark, "ingested"), _place(spark, "checkpoint"), _place(spark, "arrivals")
    m = messages(spark, sf_dir)
    m.where("direction = 'sent'").write.parquet(f"{arrivals}/first")
    stream = spark.readStream.schema(m.schema).option("recursiveFileLookup", "true").parquet(arrivals)
    stateful.ingest_stream(stream, out, at)
    m.withColumn("is_read", (F.col("folder") == "Projects") != F.col("is_read")).write.parquet(f"{arrivals}/second")
    stateful.ingest_stream(stream, out, at)
    return spark.read.option("basePath", out).parquet(out).where("epoch = 1").select("message_id", "status")


def stream_thread_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they come, day after day; timers turn threads stale."""
    out, arrivals = _place(spark, "threads"), _place(spark, "arrivals")
    m = messages(spark, sf_dir).select("conversation_id", "message_id", "mine", "is_replied", "email_type", "date")
    cuts = ["2024-01-01", "2024-01-06", "2024-01-20", "2100-01-01"]
    files = spark.sparkContext.defaultParallelism
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):  # as many files of each span, in this order, so that an epoch is a span
        _written_as(m.where((F.col("date") >= low) & (F.col("date") < high)), f"{arrivals}/{i}", files)
    stream = spark.readStream.schema(m.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(arrivals)
    stateful.keep_thread_states(stream, out, _place(spark, "checkpoint"))
    return stateful.current_states(spark, out)


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts' mailboxes followed from their watermarks, with a restart: what came late within the overlap is taken, what was read twice is taken once."""
    box, out, at = _place(spark, "mailbox"), _place(spark, "synced"), _place(spark, "checkpoint")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date"), "user_id").withColumn("account", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")))
    shape = "account string, message_id string, date timestamp_ntz, body string, is_read boolean, is_replied boolean, is_flagged boolean"
    mail = e.select("account", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("message_id"), "date", F.lit("").alias("body"), *[F.lit(False).alias(f) for f in ("is_read", "is_replied", "is_flagged")], "event_id")
    spark.dataSource.register(mailbox_stream.MailboxSource)
    early = (F.col("date") < "2024-01-12") & (F.col("event_id") % 5 != 0)
    for part in (mail.where(early), mail.where(~early)):
        _deliver(part.drop("event_id"), box)
        stateful.ingest_stream(spark.readStream.format("mailbox").schema(shape).option("path", box).load(), out, at)
    return stateful.ingested(spark, out, "new").select("account", "message_id")


def rfc822_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as mail files in binary form, and parsed."""
    m = messages(spark, sf_dir)
    raw = F.concat(F.lit("Message-ID: <"), "message_id", F.lit(">\r\nFrom: \"A B\" <"), "sender", F.lit(">\r\nTo: "), "recipient1", F.lit(", "), "recipient2", F.lit("\r\nSubject: test\r\nDate: "), F.date_format("date", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000\r\nX-Priority: 1 (Highest)\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.replace("body", F.lit("\n"), F.lit("\r\n")))
    parsed = rfc822.parse_column(m.select(F.col("message_id").alias("path"), F.encode(raw, "UTF-8").alias("content")))
    return parsed.select("message_id", "sender", "sender_name", F.array_join("recipients_to", ",").alias("recipients"), F.col("sent_date").alias("date"), F.replace("body_text", F.lit("\r\n"), F.lit("\n")).alias("body"))


def mail_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the attachments of mail files: a note, a page, and a picture, which has none."""
    part = lambda kind, name, body: F.concat(F.lit(f"--b\r\nContent-Type: {kind}\r\nContent-Disposition: attachment; filename=\"{name}\"\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), body, F.lit("\r\n"))
    raw = F.concat(F.lit("Message-ID: <"), "message_id", F.lit(">\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"b\"\r\n\r\n"), part("text/plain", "n.txt", F.concat(F.lit("note of "), "message_id")), part("application/octet-stream", "p.htm", F.concat(F.lit("<p>page of</p><p>"), "message_id", F.lit("</p>"))), part("image/png", "i.png", F.lit("x")), F.lit("--b--\r\n"))
    parsed = rfc822.parse_column(messages(spark, sf_dir).select(F.col("message_id").alias("path"), F.encode(raw, "UTF-8").alias("content")))
    return rfc822.attachment_texts(parsed)


Q = {f.__name__: f for f in (stream_daily_volume, stream_dedup, stream_ingest, stream_changes, stream_thread_states, stream_sync, rfc822_parse, mail_attachments)}
from postloom.plans.mail import HASH  # noqa: E402
from postloom.plans.views import LATEST, MESSAGES  # noqa: E402

_OLD = "date < (SELECT max(date) FROM messages WHERE conversation_id <> '') - INTERVAL 14 DAYS"

SQL = {
    "stream_daily_volume": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_ingest": f"{MESSAGES[:-1]}, k AS (SELECT message_id, date, {HASH('body')} AS bh FROM messages) SELECT arg_min(message_id, (date, message_id)) AS message_id FROM k WHERE bh IS NOT NULL GROUP BY bh UNION ALL SELECT message_id FROM k WHERE bh IS NULL",
    "stream_changes": f"{MESSAGES[:-1]}, k AS (SELECT *, {HASH('body')} AS bh, CASE WHEN folder = 'Projects' THEN NOT is_read ELSE is_read END AS r FROM messages), s AS (SELECT message_id, bh, is_read FROM k WHERE direction = 'sent' QUALIFY bh IS NULL OR row_number() OVER (PARTITION BY bh ORDER BY date, message_id) = 1), n AS (SELECT k.message_id, k.bh, k.date, CASE WHEN direction = 'sent' THEN CASE WHEN k.r <> k.is_read THEN 'changed' ELSE 'duplicate' END WHEN k.bh IN (SELECT bh FROM s) THEN 'duplicate' ELSE 'candidate' END AS status FROM k) SELECT message_id, CASE WHEN status <> 'candidate' THEN status WHEN bh IS NULL OR row_number() OVER (PARTITION BY bh, status ORDER BY date, message_id) = 1 THEN 'new' ELSE 'duplicate' END AS status FROM n",
    "stream_thread_states": f"{LATEST} SELECT conversation_id, message_id, message_count, CASE WHEN {_OLD} AND mine THEN 'stale' WHEN {_OLD} THEN 'stale_needs_action' WHEN mine THEN 'awaiting_response' WHEN is_replied THEN 'completed' ELSE 'needs_action' END AS state FROM last_rows WHERE NOT all_notes",
    "stream_sync": "WITH e AS (SELECT 'u' || (user_id % 7) AS account, event_id, ts, ts < TIMESTAMP '2024-01-12' AND event_id % 5 <> 0 AS early FROM events), w AS (SELECT account, max(ts) AS mark FROM e WHERE early GROUP BY 1) SELECT account, 'e' || event_id AS message_id FROM e LEFT JOIN w USING (account) WHERE early OR mark IS NULL OR ts >= mark - INTERVAL 1 HOUR",
    "mail_attachments": f"{MESSAGES} SELECT message_id, f AS filename, CASE f WHEN 'n.txt' THEN 'note of ' || message_id WHEN 'p.htm' THEN 'page of' || chr(10) || chr(10) || message_id ELSE '' END AS text FROM messages, unnest(['n.txt', 'p.htm', 'i.png']) u(f)",
    "rfc822_parse": f"{MESSAGES} SELECT message_id, sender, 'A B' AS sender_name, recipient1 || ',' || recipient2 AS recipients, date, body FROM messages",
}
