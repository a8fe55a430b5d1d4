"""Message views over the test tables, in Spark and, with the same rules, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-25 00:00:00"
#: My addresses contain this, in the view's identity.
ME = "assistant"

# Expressions that read the same in both dialects.
DOMAIN = "CASE conv_id % 5 WHEN 0 THEN 'acme.com' WHEN 1 THEN 'globex.org' WHEN 2 THEN 'initech.net' WHEN 3 THEN 'gmail.com' ELSE 'umbrella.co' END"
BODY = "text || CASE WHEN prev IS NULL THEN '' ELSE chr(10) || chr(10) || 'On Mon, Jan 01, 2024 at 10:00 a colleague wrote:' || chr(10) || '> ' || replace(substr(prev, 1, 80), chr(10), chr(10) || '> ') END || CASE WHEN turn % 2 = 1 THEN chr(10) || '-- ' || chr(10) || 'Sent from my phone' ELSE '' END || CASE WHEN (conv_id + turn) % 5 = 4 THEN chr(10) || 'Please delete this message after reading.' ELSE '' END"
COLUMNS = {
    "conv_id": "conv_id",
    "turn": "turn",
    "message_id": "'m' || conv_id || '-' || turn",
    "conversation_id": "CASE WHEN conv_id % 11 = 10 THEN '' ELSE 'c' || conv_id END",
    "sender": f"role || ((conv_id + turn) % 7) || '@' || {DOMAIN}",
    "sender_name": "CASE WHEN turn % 3 = 0 THEN '' ELSE upper(substr(role, 1, 1)) || substr(role, 2) || ' ' || ((conv_id + turn) % 7) END",
    "recipient1": "'r' || ((conv_id + turn) % 9) || '@example.org'",
    "recipient2": "'team' || (conv_id % 4) || '@example.org'",
    "direction": "CASE role WHEN 'assistant' THEN 'sent' ELSE 'received' END",
    "email_type": "CASE role WHEN 'system' THEN 'meeting_note' ELSE '' END",
    "folder": "CASE turn % 4 WHEN 0 THEN 'INBOX' WHEN 1 THEN 'Sent Items' WHEN 2 THEN 'Archive' ELSE 'Projects' END",
    "is_replied": "(conv_id + turn) % 3 = 0",
    "is_read": "turn % 2 = 0",
    "is_flagged": "turn = 4",
    "mine": f"role = '{ME}'",
    "subject": "CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || replace(substr(head, 1, 40), chr(10), ' ')",
    "body": BODY,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each turn. Joins on (conversation, turn), which Spark can split where one conversation is long."""
    raw = table(spark, sf_dir, "conversations")
    heads = raw.groupBy("conv_id").agg(F.min_by("text", "turn").alias("head"))
    prev = raw.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    rows = raw.join(heads, "conv_id").join(prev, ["conv_id", "turn"], "left")
    hours, minutes = F.make_dt_interval(hours=((F.col("conv_id") % 120) * 6).cast("int")), F.make_dt_interval(mins=(F.col("turn") * 37).cast("int"))
    return rows.select(*[F.expr(e).alias(c) for c, e in COLUMNS.items()], (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hours + minutes).alias("date"))


MESSAGES = (
    "WITH raw AS (SELECT r.conv_id, r.turn, r.role, r.text, h.head, p.text AS prev FROM conversations r JOIN (SELECT conv_id, arg_min(text, turn) AS head FROM conversations GROUP BY conv_id) h ON h.conv_id = r.conv_id "
    "LEFT JOIN conversations p ON p.conv_id = r.conv_id AND p.turn = r.turn - 1), "
    "messages AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + ", TIMESTAMP '2024-01-01 00:00:00' + to_hours(((conv_id % 120) * 6)::INTEGER) + to_minutes((turn * 37)::INTEGER) AS date FROM raw) "
)

#: The latest message of each conversation, as the thread rules see it.
LATEST = MESSAGES[:-1] + ", latest AS (SELECT *, count(*) OVER w AS message_count, min(date) OVER w AS first_date, max(date) OVER w AS last_date, bool_and(email_type = 'meeting_note') OVER w AS all_notes, row_number() OVER (PARTITION BY conversation_id ORDER BY date DESC, message_id DESC) AS rn FROM messages WHERE conversation_id <> '' WINDOW w AS (PARTITION BY conversation_id)), last_rows AS (SELECT * FROM latest WHERE rn = 1) "
STALE = f"date < TIMESTAMP '{NOW}' - INTERVAL 14 DAYS"
