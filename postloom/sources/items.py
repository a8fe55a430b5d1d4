"""Items of archives, desktop clients and calendars, and records as stores and pages give them, as message columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.message import blank, email_type

# Codes that archives and desktop clients use.
TO, CC, BCC = 1, 2, 3
READ = 1
MAIL_CLASS, MEETING_CLASS = 43, 26
REPLIED, FORWARDED = (102, 103), (104,)
FLAGGED = 2
IMPORTANCE = {2: "high", 0: "low"}
BUSY = {0: "free", 1: "tentative", 2: "busy", 3: "out_of_office", 4: "working_elsewhere"}

ARCHIVE_ITEM = "folder string, message_identifier string, internet_message_id string, sender string, sender_name string, subject string, client_submit_time timestamp_ntz, delivery_time timestamp_ntz, recipients array<struct<address:string,kind:int>>, plain_text_body string, html_body string, message_flags int, conversation_topic string, in_reply_to_id string"
DESKTOP_ITEM = "folder string, class int, internet_message_id string, entry_id string, conversation_id string, conversation_topic string, sender string, sender_name string, to string, cc string, bcc string, subject string, sent_on timestamp_ntz, received_time timestamp_ntz, body string, html_body string, unread boolean, last_verb int, flag_status int, importance int"
CALENDAR_ITEM = "class int, subject string, start timestamp_ntz, end timestamp_ntz, location string, body string, organizer string, required string, optional string, all_day boolean, recurring boolean, busy_status int"


def split_names(c: Column, sep: str = ";") -> Column:
    """The names between separators, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def of_kind(recipients: Column, kind: int) -> Column:
    """Addresses of the recipients of one kind."""
    some = F.coalesce(recipients, F.array().cast("array<struct<address:string,kind:int>>"))
    return F.transform(F.filter(some, lambda r: r["kind"] == kind), lambda r: F.coalesce(r["address"], F.lit("")))


def first_of(*columns: Column) -> Column:
    """The first that isn't blank, or an empty string."""
    return F.coalesce(*[F.when(~blank(c), c) for c in columns], F.lit(""))


def sent_or_received(folder: Column) -> Column:
    return F.when(F.lower(F.coalesce(folder, F.lit(""))).rlike("sent|outbox"), "sent").otherwise("received")


def is_read(flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(READ) != 0, F.lit(False))


def was_replied(verb: Column) -> Column:
    return F.coalesce(verb.isin(*REPLIED), F.lit(False))


def was_forwarded(verb: Column) -> Column:
    return F.coalesce(verb.isin(*FORWARDED), F.lit(False))


def is_flagged(status: Column) -> Column:
    return F.coalesce(status == FLAGGED, F.lit(False))


def importance(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in IMPORTANCE.items() for x in (F.lit(k), F.lit(v))]), code.cast("int")), F.lit("normal"))


def archive_messages(items: DataFrame, bots: tuple[str, ...] = ()) -> DataFrame:
    """Messages of archive items (ARCHIVE_ITEM). The topic is the thread's key; HTML bodies serve where there is no plain one."""
    from postloom.functions.text import html_to_text

    c = F.col
    return items.select(
        first_of(c("message_identifier"), c("internet_message_id")).alias("message_id"),
        F.coalesce("conversation_topic", F.lit("")).alias("conversation_id"),
        F.coalesce("sender", F.lit("")).alias("sender"),
        F.coalesce("sender_name", F.lit("")).alias("sender_name"),
        *[of_kind(c("recipients"), k).alias(n) for k, n in ((TO, "recipients_to"), (CC, "recipients_cc"), (BCC, "recipients_bcc"))],
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.when(~blank(c("plain_text_body")), c("plain_text_body")).otherwise(html_to_text(c("html_body"))).alias("body"),
        F.coalesce("client_submit_time", "delivery_time").alias("sent_date"),
        c("delivery_time").alias("received_date"),
        "folder",
        F.lit("archive").alias("source"),
        sent_or_received(c("folder")).alias("direction"),
        is_read(c("message_flags")).alias("is_read"),
        F.coalesce("in_reply_to_id", F.lit("")).alias("in_reply_to"),
        F.coalesce(email_type(c("sender"), bots), F.lit("")).alias("email_type"),
    )


def desktop_messages(items: DataFrame, bots: tuple[str, ...] = ()) -> DataFrame:
    """Messages of desktop items (DESKTOP_ITEM) that are mail."""
    from postloom.functions.text import html_to_text

    c = F.col
    return items.where(c("class") == MAIL_CLASS).select(
        first_of(c("internet_message_id"), c("entry_id")).alias("message_id"),
        first_of(c("conversation_id"), c("conversation_topic")).alias("conversation_id"),
        F.coalesce("sender", F.lit("")).alias("sender"),
        F.coalesce("sender_name", F.lit("")).alias("sender_name"),
        *[split_names(c(n)).alias(f"recipients_{n}") for n in ("to", "cc", "bcc")],
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.when(~blank(c("body")), c("body")).otherwise(html_to_text(c("html_body"))).alias("body"),
        c("sent_on").alias("sent_date"),
        c("received_time").alias("received_date"),
        "folder",
        F.lit("desktop").alias("source"),
        sent_or_received(c("folder")).alias("direction"),
        F.coalesce(~c("unread"), F.lit(False)).alias("is_read"),
        was_replied(c("last_verb")).alias("is_replied"),
        was_forwarded(c("last_verb")).alias("is_forwarded"),
        is_flagged(c("flag_status")).alias("is_flagged"),
        importance(c("importance")).alias("importance"),
        F.coalesce(email_type(c("sender"), bots), F.lit("")).alias("email_type"),
    )


def meetings(items: DataFrame) -> DataFrame:
    """Meetings of calendar items (CALENDAR_ITEM) that are appointments; bodies are whole."""
    c = F.col
    busy = F.create_map(*[x for k, v in BUSY.items() for x in (F.lit(k), F.lit(v))])
    required, optional = split_names(c("required")), split_names(c("optional"))
    return items.where(c("class") == MEETING_CLASS).select(
        F.coalesce("subject", F.lit("")).alias("subject"), "start", "end",
        F.coalesce(F.timestamp_diff("MINUTE", c("start"), c("end")), F.lit(0)).cast("int").alias("duration_minutes"),
        *[F.coalesce(n, F.lit("")).alias(n) for n in ("location", "body", "organizer")],
        required.alias("required_attendees"), optional.alias("optional_attendees"), F.concat(required, optional).alias("all_attendees"),
        F.coalesce("all_day", F.lit(False)).alias("is_all_day"), F.coalesce("recurring", F.lit(False)).alias("is_recurring"),
        F.coalesce(F.try_element_at(busy, c("busy_status")), F.lit("busy")).alias("busy_status"),
    )


def metadata(recipients: Column, subject: Column, date: Column, names: Column, most_recipients: int | None = 5, most_subject: int | None = 500, most_names: int | None = 10) -> list[Column]:
    """recipients, subject, date, attachment_names as flat strings for a vector store, which holds short ones only; None keeps all."""
    first = lambda c, n: F.array_join(c if n is None else F.slice(c, 1, n), ",")
    title = F.coalesce(subject, F.lit(""))
    named = F.filter(names if most_names is None else F.slice(names, 1, most_names), lambda n: ~blank(n))
    return [first(recipients, most_recipients).alias("recipients"), (title if most_subject is None else F.substring(title, 1, most_subject)).alias("subject"), F.coalesce(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("date"), F.array_join(named, ",").alias("attachment_names")]


#: Fields of a record that have a form of their own.
RECORD = "message_id string, conversation_id string, sender string, subject string, direction string, sent_date string, received_date string, is_read boolean"
DIRECTIONS = ("sent", "received")


def from_record(json: Column) -> Column:
    """struct of a JSON record: unknown keys are left out, dates that are none and directions that are none become null."""
    raw = F.from_json(json, RECORD)
    at = lambda name: F.try_to_timestamp(F.replace(raw[name], F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")).cast("timestamp_ntz")
    return F.struct(*[raw[n].alias(n) for n in ("message_id", "conversation_id", "sender", "subject")], F.when(raw["direction"].isin(*DIRECTIONS), raw["direction"]).alias("direction"), at("sent_date").alias("sent_date"), at("received_date").alias("received_date"), raw["is_read"].alias("is_read"))


def shown(document: Column, relevance: Column, chars: int = 200) -> list[Column]:
    """preview and relevance (percent, one decimal) of a hit, as a page of results shows it."""
    return [F.substring(document, 1, chars).alias("preview"), F.round(100 * relevance, 1).alias("relevance")]
