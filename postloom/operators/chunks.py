"""Messages as chunks for indexing, and one summary chunk for each thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import text as T

CHUNK = "struct<kind:string,suffix:string,chunk_index:int,text:string>"


def chunks_of(document: Column, subject: Column, most: int = 800, least: int = 50) -> Column:
    """array<struct<kind, suffix, chunk_index, text>>: fresh, quoted and attachment chunks, or those of the cleaned document if there are none. No text is cut off: what is longer than `most` goes on in further chunks.

    Attachment sections are cut out of the body first, so their text is chunked once.
    """

    head = F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("")))
    none = F.array().cast(f"array<{CHUNK}>")
    piece = lambda kind, first, rest: lambda t, i: F.struct(F.lit(kind).alias("kind"), F.when(i == 0, F.lit(first)).otherwise(F.concat(F.lit(rest), i.cast("string"))).alias("suffix"), i.alias("chunk_index"), t.alias("text"))
    packed = lambda text, *names: T.bind(text, lambda t: F.when(F.length(t) >= least, F.transform(T.pack_paragraphs(t, most), piece(*names))).otherwise(none))

    def section(x: Column, k: Column) -> Column:
        name = F.concat(F.lit("_att"), k.cast("string"))
        return F.when(F.length(x["text"]) >= least, F.transform(T.pack_paragraphs(x["text"], most), lambda t, i: F.struct(F.lit("attachment").alias("kind"), F.when(i == 0, name).otherwise(F.concat(name, F.lit("_"), i.cast("string"))).alias("suffix"), i.alias("chunk_index"), F.concat(head, F.lit("\n[Attachment: "), x["name"], F.lit("]\n\n"), t).alias("text")))).otherwise(none)

    def made(doc: Column, header: Column, s: Column) -> Column:
        a = packed(T.strip(F.when(s["fresh"] != "", F.concat(header, F.lit("\n\n"), s["fresh"])).otherwise(header)), "fresh", "_fresh", "_f")
        b = F.when(F.length(s["quoted"]) >= least, packed(F.concat(head, F.lit("\n[Quoted history]\n\n"), s["quoted"]), "quoted", "_quoted", "_q")).otherwise(none)
        c = F.flatten(F.transform(T.attachment_sections(doc), section))
        return T.bind(F.concat(a, b, c), lambda found: F.when(F.size(found) > 0, found).otherwise(packed(T.clean_text(doc), "fresh", "_fresh", "_f")))

    def split(doc: Column, parts: Column) -> Column:
        return T.bind(T.segment(F.regexp_replace(parts["body"], r"(?s)\n?\[Attachment: .*", "")), lambda s: made(doc, parts["header"], s))

    return T.bind(F.coalesce(document, F.lit("")), lambda doc: T.bind(T.split_header_body(doc), lambda parts: split(doc, parts)))


def chunk(messages: DataFrame, most: int = 800, least: int = 50) -> DataFrame:
    """email_id, chunk_id, kind, chunk_index, text of messages (email_id, document, subject). No shuffle."""
    made = messages.select("email_id", F.explode(chunks_of(F.col("document"), F.col("subject"), most, least)).alias("c"))
    return made.select("email_id", F.concat("email_id", "c.suffix").alias("chunk_id"), "c.kind", "c.chunk_index", "c.text")


#: Characters that a line of a summary has at least.
LINE_LEAST = 24


def summaries(messages: DataFrame, most_chars: int | None = 1200, most_people: int | None = 8) -> DataFrame:
    """One chunk for each thread of two messages or more: subject, count, period, participants, and a line for each message.

    A summary is an entry to the thread, whose messages have chunks of their own: it names the first
    `most_people` by name and keeps `most_chars` characters; None keeps all. Only messages whose
    lines can fit leave their rows, so a long thread is never gathered as a whole.
    """
    name = F.coalesce(F.nullif("sender_name", F.lit("")), "sender")
    stamp = F.coalesce(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    rows = messages.where("coalesce(conversation_id, '') <> ''").select("conversation_id", stamp.alias("date"), "message_id", name.alias("name"), "subject", F.when(F.col("direction") == "sent", "SENT").otherwise("RECV").alias("way"), F.col("body"))
    g = rows.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("subject", F.struct("date", "message_id")).alias("subject"), F.array_sort(F.collect_set("name")).alias("people")).where("message_count >= 2")
    if most_chars is not None:
        place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("date", "message_id"))
        rows = rows.withColumn("place", place).where(F.col("place") <= most_chars // LINE_LEAST + 1)
    line = F.concat(F.lit("  ["), F.substring("date", 1, 16), F.lit("] "), "way", F.lit(" "), "name", F.lit(": "), T.first_line(F.col("body")))
    lines = rows.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("date", "message_id", line.alias("line")))).alias("ms"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Thread: "), "subject"),
        F.concat(F.lit("Messages: "), F.col("message_count").cast("string")),
        F.concat(F.lit("Period: "), F.substring("first", 1, 10), F.lit(" to "), F.substring("last", 1, 10)),
        F.concat(F.lit("Participants: "), F.array_join("people" if most_people is None else F.slice("people", 1, most_people), ", ")),
        F.lit("\nTimeline:"),
        F.transform("ms", lambda m: m["line"]),
    )
    text = text if most_chars is None else F.substring(text, 1, most_chars)
    return g.join(lines, "conversation_id").select("conversation_id", F.substring(F.sha2(F.concat(F.lit("thread_summary_"), "conversation_id"), 256), 1, 32).alias("chunk_id"), "message_count", text.alias("text"))
