"""Scalar rules on one message: columns in, column out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def unique_id(message_id: Column, sender: Column, subject: Column, sent: Column) -> Column:
    """32 hex digits of the message id, or of sender, subject and date where there is none."""
    rest = F.concat_ws(":", F.coalesce(sender, F.lit("")), F.coalesce(subject, F.lit("")), F.coalesce(sent.cast("string"), F.lit("None")))
    return F.substring(F.sha2(F.when(blank(message_id), rest).otherwise(message_id), 256), 1, 32)


def effective_date(sent: Column, received: Column) -> Column:
    return F.coalesce(sent, received)


def all_recipients(to: Column, cc: Column, bcc: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(c, none) for c in (to, cc, bcc)])


def direction(folder: Column, sender: Column, account: Column) -> Column:
    out = F.lower(F.coalesce(folder, F.lit(""))).rlike("sent|envoy|outbox") | (F.lower(F.trim(sender)) == F.lower(F.trim(account)))
    return F.when(out, "sent").otherwise("received")


def conversation_id(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    return F.coalesce(F.nullif(F.get(references, 0), F.lit("")), F.nullif(in_reply_to, F.lit("")), F.nullif(message_id, F.lit("")))


def importance(x_priority: Column) -> Column:
    n = F.substring(F.trim(x_priority), 1, 1).try_cast("int")
    return F.when(n <= 2, "high").when(n >= 4, "low").otherwise("normal")


def email_type(sender: Column, bots: Iterable[str]) -> Column:
    return F.when(F.lower(F.trim(sender)).isin(*bots), "meeting_note").otherwise("")


def display_name(name: Column, sender: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), sender)


def is_mine(sender: Column, addresses: Iterable[str]) -> Column:
    """The sender is or contains one of my addresses."""
    s = F.lower(F.trim(F.coalesce(sender, F.lit(""))))
    return F.exists(F.array(*[F.lit(a.lower()) for a in addresses]), lambda a: F.contains(s, a))


def document(m: dict[str, Column], most_body: int | None = None, most_attachment: int | None = None) -> Column:
    """Searchable text: optional lines of metadata, a blank line, the body and the attachments. All of them, or the first `most_body` and `most_attachment` characters of each, for stores that can't hold more: what is cut there is never found. Keys: email_type, sender, sender_name, recipients, subject, date, folder, body, attachments (array of filename and text)."""
    line = lambda label, c, when: F.when(when, F.concat(F.lit(label), c))
    body = F.coalesce(m["body"], F.lit(""))
    shown = body if most_body is None else F.when(F.length(body) > most_body, F.concat(F.substring(body, 1, most_body), F.lit("..."))).otherwise(body)
    part = (lambda c: c) if most_attachment is None else (lambda c: F.substring(c, 1, most_attachment))
    attached = F.transform(F.filter(m["attachments"], lambda a: ~blank(a["text"])), lambda a: F.concat(F.lit("\n[Attachment: "), a["filename"], F.lit("]\n"), part(a["text"])))
    return F.concat_ws(
        "\n",
        F.when(m["email_type"] == "meeting_note", "[Meeting Summary]"),
        line("From: ", display_name(m["sender_name"], m["sender"]), ~blank(m["sender"])),
        line("To: ", F.array_join(m["recipients"], ", "), F.size(m["recipients"]) > 0),
        line("Subject: ", m["subject"], ~blank(m["subject"])),
        line("Date: ", F.date_format(m["date"], "yyyy-MM-dd HH:mm"), m["date"].isNotNull()),
        line("Folder: ", m["folder"], ~blank(m["folder"])),
        F.lit(""),
        F.when(body != "", shown),
        attached,
    )


def web_link(base: str, subject: Column, sender: Column) -> Column:
    """A search address with up to 80 characters of the subject, without quotes, and the sender."""
    plain = F.substring(F.regexp_replace(F.coalesce(subject, F.lit("")), "[\"']", ""), 1, 80)
    query = F.concat_ws(" ", F.nullif(plain, F.lit("")), F.when(~blank(sender), F.concat(F.lit("from:"), sender)))
    return F.concat(F.lit(base), F.url_encode(query))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")
