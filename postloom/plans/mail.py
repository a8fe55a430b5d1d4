"""Queries on messages: scalars, filters, threads, analytics. Each has its SQL beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postloom.functions import filters, message
from postloom.functions import text as T
from postloom.operators import analytics, calendar, threads
from postloom.plans.views import LATEST, ME, MESSAGES, NOW, STALE, messages, table
from postloom.sources import items

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers a function of (messages, spark, sf_dir)."""

    def add(f):
        Q[name] = lambda spark, sf_dir: f(messages(spark, sf_dir), spark, sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


# --- threads ------------------------------------------------------------------------------------

STATE = f"CASE WHEN {STALE} AND mine THEN 'stale' WHEN {STALE} THEN 'stale_needs_action' WHEN mine THEN 'awaiting_response' WHEN is_replied THEN 'completed' ELSE 'needs_action' END"
ALONE = f"CASE WHEN mine THEN 'awaiting_response' WHEN is_replied THEN 'completed' WHEN {STALE} THEN 'stale_needs_action' ELSE 'needs_action' END"
RESEARCH = "CASE WHEN direction <> 'sent' AND NOT is_replied THEN 'needs_action' WHEN direction = 'sent' THEN 'awaiting_response' ELSE 'completed' END"
OPEN = f"{LATEST}, states AS (SELECT conversation_id, message_id, subject, date, {STATE} AS state FROM last_rows WHERE NOT all_notes UNION ALL SELECT '', message_id, subject, date, {ALONE} FROM messages WHERE conversation_id = '' AND email_type <> 'meeting_note'), open AS (SELECT conversation_id, message_id, subject, date, CASE WHEN state LIKE 'stale%' THEN 'stale' ELSE state END AS bucket FROM states WHERE state <> 'completed') "


@query("thread_states", f"{LATEST} SELECT conversation_id, message_id, subject, sender, message_count, last_date, {STATE} AS state FROM last_rows WHERE NOT all_notes")
def _(m, *_a):
    return threads.thread_states(m, NOW).select("conversation_id", "message_id", "subject", "sender", "message_count", "last_date", "state")


@query("standalone_states", f"{MESSAGES} SELECT message_id, {ALONE} AS state FROM messages WHERE conversation_id = '' AND email_type <> 'meeting_note'")
def _(m, *_a):
    return threads.standalone_states(m, NOW).select("message_id", "state")


@query("open_items", f"{OPEN} SELECT * FROM open")
def _(m, *_a):
    return threads.buckets(m, NOW)


@query("thread_buckets", f"{OPEN} SELECT bucket, count(*) AS n, max(date) AS latest FROM open GROUP BY bucket")
def _(m, *_a):
    return threads.buckets(m, NOW).groupBy("bucket").agg(F.count("*").alias("n"), F.max("date").alias("latest"))


@query("research_timeline", f"{LATEST}, people AS (SELECT conversation_id, string_agg(DISTINCT sender, ',' ORDER BY sender) AS participants FROM messages WHERE conversation_id <> '' GROUP BY conversation_id) SELECT l.conversation_id AS id, first_date, last_date, message_count, participants, subject, {RESEARCH} AS status FROM last_rows l JOIN people p ON p.conversation_id = l.conversation_id UNION ALL SELECT message_id, date, date, 1, sender, subject, {RESEARCH} FROM messages WHERE conversation_id = ''")
def _(m, *_a):
    return threads.timeline(m)


@query("thread_status_prompt", f"{LATEST} SELECT conversation_id, CASE WHEN direction = 'sent' AND NOT is_replied THEN 'AWAITING RESPONSE' WHEN direction <> 'sent' AND NOT is_replied THEN 'NEEDS ACTION' ELSE 'COMPLETED' END AS status FROM last_rows")
def _(m, *_a):
    return threads.latest(m).select("conversation_id", threads.prompt_state().alias("status"))


@query("thread_model_flags", f"{LATEST} SELECT conversation_id, direction = 'sent' AND NOT is_replied AS awaiting, direction <> 'sent' AND NOT is_replied AND NOT is_read AS needs_action FROM last_rows")
def _(m, *_a):
    awaiting, needs = threads.model_flags()
    return threads.latest(m).select("conversation_id", awaiting.alias("awaiting"), needs.alias("needs_action"))


@query("thread_latest_date", f"{MESSAGES} SELECT conversation_id, max(date) AS latest FROM messages WHERE conversation_id <> '' GROUP BY 1")
def _(m, *_a):
    return threads.latest(m).select("conversation_id", F.col("last_date").alias("latest"))


@query("bot_only_exclusion", f"{MESSAGES} SELECT conversation_id, count(*) AS n FROM messages WHERE conversation_id <> '' GROUP BY 1 HAVING NOT bool_and(email_type = 'meeting_note')")
def _(m, *_a):
    return threads.latest(m).where("not all_notes").select("conversation_id", F.col("message_count").alias("n"))


DEADLINE = "lower(body) LIKE '%urgent%' OR lower(body) LIKE '%the%'"
# --- analytics ----------------------------------------------------------------------------------


@query("mailbox_stats", f"{MESSAGES} SELECT count(*) AS total, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction <> 'sent') AS received, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_flagged) AS flagged FROM messages")
def _(m, *_a):
    return analytics.mailbox_stats(m)


VOLUME = "SELECT date::DATE AS day, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction <> 'sent') AS received FROM messages GROUP BY 1"
@query("volume_by_date", f"{MESSAGES} {VOLUME}")
def _(m, *_a):
    return analytics.volume_by_date(m)


@query("hourly_distribution", f"{MESSAGES} SELECT h.range AS hour, count(m.date) AS n FROM range(24) h LEFT JOIN messages m ON hour(m.date) = h.range GROUP BY 1")
def _(m, *_a):
    return analytics.hourly(m)


@query("top_senders", f"{MESSAGES} SELECT coalesce(nullif(sender_name, ''), sender) AS name, count(*) AS n FROM messages WHERE direction = 'received' GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def _(m, *_a):
    return analytics.top(m.where("direction = 'received'"), message.display_name(F.col("sender_name"), F.col("sender")))


@query("top_recipients", f"{MESSAGES} SELECT name, count(*) AS n FROM (SELECT unnest([recipient1, recipient2]) AS name FROM messages WHERE direction = 'sent') GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def _(m, *_a):
    return analytics.top(m.where("direction = 'sent'").select(F.explode(F.array("recipient1", "recipient2")).alias("r")), F.trim("r"))


@query("folder_distribution", f"{MESSAGES} SELECT folder, count(*) AS n FROM messages GROUP BY 1")
def _(m, *_a):
    return analytics.folders(m)


@query("sent_received_ratio", f"{MESSAGES} SELECT sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received, round(sum(sent) / sum(received), 4) AS ratio FROM ({VOLUME})")
def _(m, *_a):
    return analytics.sent_received_ratio(m)


@query("distinct_threads", f"{MESSAGES} SELECT count(DISTINCT nullif(conversation_id, '')) AS n FROM messages")
def _(m, *_a):
    return m.agg(F.count_distinct(F.nullif("conversation_id", F.lit(""))).alias("n"))


# --- scalars ------------------------------------------------------------------------------------


@query("message_unique_id", f"{MESSAGES} SELECT message_id, substr(sha256(CASE WHEN turn % 4 = 3 THEN sender || ':' || subject || ':' || strftime(date, '%Y-%m-%d %H:%M:%S') ELSE message_id END), 1, 32) AS uid FROM messages")
def _(m, *_a):
    return m.select("message_id", message.unique_id(F.when(F.col("turn") % 4 != 3, F.col("message_id")), F.col("sender"), F.col("subject"), F.col("date")).alias("uid"))


@query("effective_date", f"{MESSAGES} SELECT message_id, coalesce(CASE WHEN turn % 2 = 0 THEN date END, date + INTERVAL 5 MINUTE) AS at FROM messages")
def _(m, *_a):
    return m.select("message_id", message.effective_date(F.when(F.col("turn") % 2 == 0, F.col("date")), F.col("date") + F.expr("INTERVAL 5 MINUTES")).alias("at"))


@query("all_recipients", f"{MESSAGES} SELECT message_id, recipient1 || ',' || recipient2 || CASE WHEN turn > 1 THEN ',' || sender ELSE '' END AS recipients FROM messages")
def _(m, *_a):
    return m.select("message_id", F.array_join(message.all_recipients(F.array("recipient1"), F.array("recipient2"), F.when(F.col("turn") > 1, F.array("sender"))), ",").alias("recipients"))


DOC = "array_to_string(list_filter([CASE WHEN email_type = 'meeting_note' THEN '[Meeting Summary]' END, 'From: ' || coalesce(nullif(sender_name, ''), sender), 'To: ' || recipient1 || ', ' || recipient2, 'Subject: ' || subject, 'Date: ' || strftime(date, '%Y-%m-%d %H:%M'), 'Folder: ' || folder, '', body, CASE WHEN turn = 2 THEN chr(10) || '[Attachment: notes.txt]' || chr(10) || body END], lambda x: x IS NOT NULL), chr(10))"


def with_document(m):
    attachments = F.when(F.col("turn") == 2, F.array(F.struct(F.lit("notes.txt").alias("filename"), F.col("body").alias("text")))).otherwise(F.array().cast("array<struct<filename:string,text:string>>"))
    return m.withColumn("document", message.document({"email_type": F.col("email_type"), "sender": F.col("sender"), "sender_name": F.col("sender_name"), "recipients": F.array("recipient1", "recipient2"), "subject": F.col("subject"), "date": F.col("date"), "folder": F.col("folder"), "body": F.col("body"), "attachments": attachments}))


@query("message_document", f"{MESSAGES} SELECT message_id, {DOC} AS document FROM messages")
def _(m, *_a):
    return with_document(m).select("message_id", "document")


@query("message_metadata", f"{MESSAGES} SELECT message_id, conversation_id, recipient1 || ',' || recipient2 AS recipients, substr(subject, 1, 500) AS subject, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, array_to_string(list_transform(list_filter(range(0, least(turn * 4, 9) + 1), lambda i: i % 3 <> 2), lambda i: 'f' || i), ',') AS attachment_names, is_read, is_replied, is_flagged FROM messages")
def _(m, *_a):
    names = F.transform(F.sequence(F.lit(0), F.col("turn") * 4), lambda i: F.when(i % 3 != 2, F.concat(F.lit("f"), i.cast("string"))))
    return m.select("message_id", "conversation_id", *items.metadata(F.array("recipient1", "recipient2"), F.col("subject"), F.col("date"), names), "is_read", "is_replied", "is_flagged")


@query("record_coercion", f"{MESSAGES} SELECT message_id, CASE WHEN turn % 3 <> 1 THEN date END AS sent_date, CASE WHEN turn % 2 = 0 THEN direction END AS direction, is_read FROM messages")
def _(m, *_a):
    sent = F.when(F.col("turn") % 3 != 1, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a date")
    raw = F.to_json(F.struct("message_id", sent.alias("sent_date"), F.when(F.col("turn") % 2 == 0, F.col("direction")).otherwise("sideways").alias("direction"), "is_read", F.lit("x").alias("unknown_key")))
    return m.select(items.from_record(raw).alias("r")).select("r.message_id", "r.sent_date", "r.direction", "r.is_read")


@query("direction_rule", f"{MESSAGES} SELECT message_id, CASE WHEN regexp_matches(lower(folder), 'sent|envoy|outbox') OR lower(trim(sender)) = 'user3@acme.com' THEN 'sent' ELSE 'received' END AS way FROM messages")
def _(m, *_a):
    return m.select("message_id", message.direction(F.col("folder"), F.col("sender"), F.lit("User3@acme.com")).alias("way"))


@query("conversation_id_rule", f"{MESSAGES} SELECT message_id, coalesce(CASE WHEN turn % 3 = 2 THEN 'm' || conv_id || '-0' END, CASE WHEN turn % 3 = 1 THEN nullif(conversation_id, '') END, message_id) AS conv FROM messages")
def _(m, *_a):
    refs = F.when(F.col("turn") % 3 == 2, F.array(F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-0")))).otherwise(F.array().cast("array<string>"))
    return m.select("message_id", message.conversation_id(refs, F.when(F.col("turn") % 3 == 1, F.col("conversation_id")), F.col("message_id")).alias("conv"))


@query("importance_rule", f"{MESSAGES} SELECT message_id, CASE WHEN (conv_id + turn) % 7 = 6 THEN 'normal' WHEN (conv_id + turn) % 7 <= 2 THEN 'high' WHEN (conv_id + turn) % 7 >= 4 THEN 'low' ELSE 'normal' END AS importance FROM messages")
def _(m, *_a):
    n = (F.col("conv_id") + F.col("turn")) % 7
    return m.select("message_id", message.importance(F.when(n == 6, "none").otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit(" (x)")))).alias("importance"))


@query("bot_tag", f"{MESSAGES} SELECT message_id, CASE WHEN sender IN ('user1@acme.com', 'user2@acme.com') THEN 'meeting_note' ELSE '' END AS kind FROM messages")
def _(m, *_a):
    return m.select("message_id", message.email_type(F.concat(F.lit(" "), F.upper("sender")), ("user1@acme.com", "user2@acme.com")).alias("kind"))


@query("display_name", f"{MESSAGES} SELECT message_id, coalesce(nullif(sender_name, ''), sender) AS name FROM messages")
def _(m, *_a):
    return m.select("message_id", message.display_name(F.col("sender_name"), F.col("sender")).alias("name"))


@query("result_projection", f"{MESSAGES} SELECT message_id, substr(body, 1, 200) AS preview, round(100 * ((conv_id % 97) / 97.0), 1) AS relevance FROM messages")
def _(m, *_a):
    return m.select("message_id", *items.shown(F.col("body"), (F.col("conv_id") % 97) / 97.0))


@query("web_link", f"{MESSAGES} SELECT message_id, 'https://mail.example.com/search/' || replace(replace(url_encode(substr(regexp_replace(subject, '[\"'']', '', 'g'), 1, 80) || ' from:' || sender), '%20', '+'), '~', '%7E') AS link FROM messages")
def _(m, *_a):
    return m.select("message_id", message.web_link("https://mail.example.com/search/", F.col("subject"), F.col("sender")).alias("link"))


@query("clock_format", f"{MESSAGES} SELECT message_id, ltrim(strftime(date, '%I:%M %p'), '0') AS clock FROM messages")
def _(m, *_a):
    return m.select("message_id", message.clock(F.col("date")).alias("clock"))


@query("flag_bitmask", f"{MESSAGES} SELECT CASE WHEN turn % 2 = 0 THEN message_id ELSE 'i' || message_id END AS message_id, conversation_id, (conv_id + turn) & 1 <> 0 AS is_read, CASE WHEN (conv_id + turn) % 3 = 0 THEN recipient1 ELSE '' END AS recipients_to, recipient2 || CASE WHEN (conv_id + turn) % 3 = 1 THEN ',' || recipient1 ELSE '' END AS recipients_cc, CASE WHEN (conv_id + turn) % 3 = 2 THEN recipient1 ELSE '' END AS recipients_bcc, CASE WHEN regexp_matches(lower(folder), 'sent|outbox') THEN 'sent' ELSE 'received' END AS direction, CASE WHEN turn % 4 = 3 THEN NULL ELSE date END AS sent_date, CASE WHEN sender = 'user3@acme.com' THEN 'meeting_note' ELSE '' END AS email_type FROM messages")
def _(m, *_a):
    """Messages as an archive holds them, parsed."""
    n = F.col("conv_id") + F.col("turn")
    even, dated = F.col("turn") % 2 == 0, F.when(F.col("turn") % 4 != 3, F.col("date"))
    raw = m.select("folder", F.when(even, F.col("message_id")).alias("message_identifier"), F.concat(F.lit("i"), "message_id").alias("internet_message_id"), "sender", "sender_name", "subject", F.when(F.col("turn") % 4 != 1, dated).alias("client_submit_time"), F.when(F.col("turn") % 4 == 1, dated).alias("delivery_time"), F.array(F.struct(F.col("recipient2").alias("address"), F.lit(2).alias("kind")), F.struct(F.col("recipient1").alias("address"), (n % 3 + 1).cast("int").alias("kind"))).alias("recipients"), F.col("body").alias("plain_text_body"), F.lit(None).cast("string").alias("html_body"), n.cast("int").alias("message_flags"), F.col("conversation_id").alias("conversation_topic"), F.lit(None).cast("string").alias("in_reply_to_id"))
    return items.archive_messages(raw, ("user3@acme.com",)).select("message_id", "conversation_id", "is_read", *[F.array_join(c, ",").alias(c) for c in ("recipients_to", "recipients_cc", "recipients_bcc")], "direction", "sent_date", "email_type")


@query("item_code_mapping", f"{MESSAGES} SELECT message_id, is_read, 2 AS people, 100 + turn IN (102, 103) AS replied, 100 + turn = 104 AS forwarded, turn % 3 = 2 AS flagged, CASE turn % 3 WHEN 2 THEN 'high' WHEN 0 THEN 'low' ELSE 'normal' END AS importance FROM messages WHERE turn <> 7")
def _(m, *_a):
    """Messages as items of a desktop client, parsed; those of turn 7 are of another class."""
    none, code = F.lit(None).cast("string"), (F.col("turn") % 3).cast("int")
    raw = m.select("folder", F.when(F.col("turn") == 7, 26).otherwise(43).alias("class"), F.col("message_id").alias("internet_message_id"), none.alias("entry_id"), none.alias("conversation_id"), F.col("conversation_id").alias("conversation_topic"), "sender", "sender_name", F.concat("recipient1", F.lit("; ;"), "recipient2").alias("to"), none.alias("cc"), none.alias("bcc"), "subject", F.col("date").alias("sent_on"), F.col("date").alias("received_time"), "body", none.alias("html_body"), (~F.col("is_read")).alias("unread"), (F.col("turn") + 100).cast("int").alias("last_verb"), code.alias("flag_status"), code.alias("importance"))
    return items.desktop_messages(raw).select("message_id", "is_read", F.col("is_replied").alias("replied"), F.col("is_forwarded").alias("forwarded"), F.col("is_flagged").alias("flagged"), "importance", F.size("recipients_to").alias("people"))


@query("recipient_split", f"{MESSAGES} SELECT message_id, recipient1 || ',' || recipient2 AS names FROM messages")
def _(m, *_a):
    raw = F.concat(F.lit(" "), "recipient1", F.lit(" ; ;"), "recipient2", F.lit(";"))
    return m.select("message_id", F.array_join(items.split_names(raw), ",").alias("names"))


@query("folder_skip", f"{MESSAGES} SELECT folder, count(*) AS n FROM (SELECT CASE WHEN turn = 5 THEN 'Bulk mail' WHEN turn = 3 THEN 'Drafts' ELSE folder END AS folder FROM messages) WHERE lower(folder) NOT IN ('trash', 'drafts', 'draft', 'deleted items') AND NOT regexp_matches(lower(folder), 'trash|spam|junk|bulk') GROUP BY 1")
def _(m, *_a):
    from postloom.sources.accounts import kept_folders

    return kept_folders(m.withColumn("folder", F.when(F.col("turn") == 5, "Bulk mail").when(F.col("turn") == 3, "Drafts").otherwise(F.col("folder")))).groupBy("folder").agg(F.count("*").alias("n"))


@query("account_parse", f"{MESSAGES} SELECT DISTINCT conv_id, 'u' || conv_id || '@x.org' AS username, 'p:' || conv_id AS secret, CASE conv_id % 4 WHEN 0 THEN 'imap.gmail.com' WHEN 1 THEN 'imap.mail.yahoo.com' WHEN 2 THEN 'outlook.office365.com' END AS host FROM messages WHERE conv_id % 4 <> 3")
def _(m, *_a):
    from postloom.sources.accounts import parse_accounts

    text = F.concat(F.element_at(F.array(F.lit("gmail"), F.lit(" Yahoo"), F.lit("outlook"), F.lit("nowhere")), (F.col("conv_id") % 4 + 1).cast("int")), F.lit(":u"), F.col("conv_id").cast("string"), F.lit("@x.org:p:"), F.col("conv_id").cast("string"), F.lit(";"))
    return parse_accounts(m.select("conv_id").distinct().withColumn("accounts", text)).select("conv_id", "username", "secret", "host")


@query("folder_list_parse", f"{MESSAGES} SELECT DISTINCT CASE WHEN folder = 'INBOX' THEN 'INBOX' ELSE folder END AS name FROM messages")
def _(m, *_a):
    from postloom.sources.accounts import folder_name

    line = F.when(F.col("folder") == "INBOX", F.concat(F.lit("(\\HasNoChildren) / "), "folder")).otherwise(F.concat(F.lit('(\\HasNoChildren) "/" "'), "folder", F.lit('"')))
    return m.select(folder_name(line).alias("name")).distinct()


@query("identity_union", f"{MESSAGES} SELECT DISTINCT lower(trim(a)) AS address FROM (SELECT unnest([' ' || sender, 'u' || conv_id || '@x.org']) AS a FROM messages)")
def _(m, *_a):
    from postloom.sources.accounts import identities

    return identities(m.select(F.concat(F.lit(" "), F.upper("sender"), F.lit(",")).alias("manual"), F.concat(F.lit("gmail:u"), F.col("conv_id").cast("string"), F.lit("@x.org:p;")).alias("accounts")))


@query("identity_predicate", f"{MESSAGES} SELECT message_id, contains(lower(sender), 'er3@acme') OR contains(lower(sender), '{ME}') AS is_mine FROM messages")
def _(m, *_a):
    return m.select("message_id", message.is_mine(F.concat(F.lit(" "), F.upper("sender")), ("ER3@acme", ME)).alias("is_mine"))


@query("topic_relevance", f"{MESSAGES} SELECT message_id, contains(lower(subject), 'the') OR contains(lower(subject), 'que') AS relevant FROM messages")
def _(m, *_a):
    from postloom.operators.graph import is_relevant

    return m.select("message_id", is_relevant(F.col("subject"), "The a que").alias("relevant"))


@query("temperature_clamp", f"{MESSAGES} SELECT message_id, least(greatest((turn - 2) / 4.0, 0.0), 1.0)::DOUBLE AS temperature FROM messages")
def _(m, *_a):
    from postloom.operators.context import clamp_temperature

    return m.select("message_id", clamp_temperature((F.col("turn") - 2) / 4.0).cast("double").alias("temperature"))


# --- questions and filters ------------------------------------------------------------------------


def _like(words):
    return " OR ".join("contains(q, '" + w.replace("'", "''") + "')" for w in words)


@query("query_type_detect", f"SELECT item_id, CASE WHEN {_like(filters.ACTION_WORDS)} THEN 'action_needed' WHEN {_like(filters.FOLLOWUP_WORDS)} THEN 'sent_followup' WHEN contains(q, 'unread') THEN 'unread' ELSE 'general' END AS kind FROM (SELECT item_id, lower(text || CASE item_id % 5 WHEN 0 THEN ' transaction' WHEN 1 THEN ' No response' WHEN 2 THEN ' unread' ELSE '' END) AS q FROM benchmark)")
def _(m, spark, sf):
    extra = F.element_at(F.array(*map(F.lit, (" transaction", " No response", " unread", "", ""))), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", filters.question_type(F.concat("text", extra)).alias("kind"))


@query("time_range_filter", f"{MESSAGES} SELECT message_id, date FROM messages WHERE date >= TIMESTAMP '2024-01-15' AND date < TIMESTAMP '2024-01-22'")
def _(m, *_a):
    where = filters.build_where({}, filters.time_range("what came last week?", datetime.fromisoformat(NOW)))
    return m.where(filters.compile_filter(where)).select("message_id", "date")


@query("metadata_filter", f"{MESSAGES} SELECT message_id FROM messages WHERE direction = 'received' AND NOT is_replied AND strftime(date, '%Y-%m-%d %H:%M:%S') >= '2024-01-10 00:00:00'")
def _(m, *_a):
    return m.where(filters.compile_filter({"ignored": 1, "$and": [{"direction": "received"}, {"is_replied": False}, {"date": {"$gte": "2024-01-10 00:00:00"}}]})).select("message_id")


# --- text ----------------------------------------------------------------------------------------

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_sql_text = lambda s: "'" + s.replace("'", "''") + "'"
BOILER = (
    f"{MESSAGES[:-1]}, l AS (SELECT message_id, subject, string_split(body, chr(10)) AS ls, length(body) AS n FROM messages), "
    f"d AS (SELECT *, coalesce(nullif(list_position(list_transform(ls, lambda x: regexp_matches({STRIP.format('x')}, {_sql_text(T.DISCLAIMER)})), true), 0), len(ls) + 1) AS d FROM l), "
    f"s AS (SELECT *, least(d, coalesce(nullif(list_position(list_transform(ls, lambda x: regexp_matches({STRIP.format('x')}, {_sql_text(T.SIGNATURE)})), true), 0), d)) AS s FROM d), "
    "boiler AS (SELECT message_id, subject, n, array_to_string(list_slice(ls, 1, s - 1), chr(10)) AS body, array_to_string(list_slice(ls, s, d - 1), chr(10)) AS signature, array_to_string(list_slice(ls, d, len(ls)), chr(10)) AS disclaimer FROM s) "
)
CLEAN = lambda c: STRIP.format(f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({c}, '(?m)^https?://\\S{{50,}}$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), chr(10)), lambda x: {STRIP.format('x')}), chr(10))")


@query("strip_boilerplate", f"{BOILER} SELECT message_id, body, signature, disclaimer FROM boiler")
def _(m, *_a):
    return m.select("message_id", T.strip_boilerplate(F.col("body")).alias("b")).select("message_id", "b.body", "b.signature", "b.disclaimer")


SEGMENT = f"{BOILER[:-1]}, placed AS (SELECT *, CASE WHEN regexp_extract(body, {_sql_text(T.WROTE)}) <> '' THEN strpos(body, regexp_extract(body, {_sql_text(T.WROTE)})) ELSE 0 END AS p FROM boiler), seg AS (SELECT message_id, subject, n, signature, disclaimer, CASE WHEN p > 0 THEN regexp_replace(substr(body, 1, p - 1), '\\s+$', '') ELSE body END AS f, CASE WHEN p > 0 THEN substr(body, p) ELSE '' END AS q FROM placed) "


@query("segment_email", f"{SEGMENT} SELECT message_id, {CLEAN('f')} AS fresh, {CLEAN('q')} AS quoted, {STRIP.format('signature')} AS signature, {STRIP.format('disclaimer')} AS disclaimer, n AS original_length, length({CLEAN('f')}) AS cleaned_length FROM seg")
def _(m, *_a):
    return m.select("message_id", T.segment(F.col("body")).alias("s")).select("message_id", "s.fresh", "s.quoted", "s.signature", "s.disclaimer", F.col("s.original_length").cast("long").alias("original_length"), F.col("s.cleaned_length").cast("long").alias("cleaned_length"))


@query("clean_text", f"SELECT doc_id, {CLEAN(chr(39) + '  ' + chr(39) + ' || replace(text, chr(10), chr(10) || chr(10) || ' + chr(39) + '  ' + chr(39) + ' || chr(10))')} AS text FROM documents")
def _(m, spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n\n  \n")))).alias("text"))


@query("split_header_body", f"{MESSAGES[:-1]}, docs AS (SELECT message_id, email_type, {DOC} AS doc FROM messages) SELECT message_id, CASE WHEN email_type = 'meeting_note' THEN '' ELSE split_part(doc, chr(10) || chr(10), 1) END AS header, CASE WHEN email_type = 'meeting_note' THEN doc ELSE substr(doc, strpos(doc, chr(10) || chr(10)) + 2) END AS body FROM docs")
def _(m, *_a):
    return with_document(m).select("message_id", T.split_header_body(F.col("document")).alias("p")).select("message_id", "p.header", "p.body")


PACK = "list_reduce(list_prepend({{'done': []::VARCHAR[], 'now': ''}}, list_transform(string_split({0}, chr(10) || chr(10)), lambda x: {{'done': []::VARCHAR[], 'now': x}})), lambda acc, p: CASE WHEN length(acc.now) + length(p.now) + 2 > {1} AND acc.now <> '' THEN {{'done': list_append(acc.done, " + STRIP.format("acc.now") + "), 'now': p.now}} ELSE {{'done': acc.done, 'now': CASE WHEN acc.now <> '' THEN acc.now || chr(10) || chr(10) || p.now ELSE p.now END}} END)"
@query("paragraph_chunks", f"WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), p AS (SELECT doc_id, text, {PACK.format('text', 800).replace('{{', '{').replace('}}', '}')} AS r FROM t), c AS (SELECT doc_id, CASE WHEN length(text) <= 800 THEN [text] WHEN {STRIP.format('r.now')} <> '' THEN list_append(r.done, {STRIP.format('r.now')}) ELSE r.done END AS cs FROM p) SELECT doc_id, len(cs) AS n, array_to_string(cs, '|') AS chunks FROM c")
def _(m, spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 800).alias("cs")).select("doc_id", F.size("cs").cast("long").alias("n"), F.array_join("cs", "|").alias("chunks"))


@query("attachment_sections", f"{MESSAGES} SELECT message_id, 'notes.txt' AS name, {STRIP.format('body')} AS text FROM messages WHERE turn = 2 AND {STRIP.format('body')} <> ''")
def _(m, *_a):
    return with_document(m).select("message_id", F.inline(T.attachment_sections(F.col("document"))))


@query("first_line", f"{MESSAGES} SELECT message_id, coalesce(substr(list_filter(list_transform(string_split({DOC}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:From|To|Subject|Date|Folder):') AND NOT starts_with(x, '>'))[1], 1, 120), '') AS line FROM messages")
def _(m, *_a):
    return with_document(m).select("message_id", T.first_line(F.col("document")).alias("line"))


@query("normalize_subject", f"{MESSAGES} SELECT message_id, {STRIP.format(chr(39) + chr(39) + ' || regexp_replace(subject, ' + chr(39) + '^(?:RE:|Re:|FW:|Fwd:|re:|fw:)\\s*' + chr(39) + ', ' + chr(39) + chr(39) + ')')} AS subject FROM messages")
def _(m, *_a):
    return m.select("message_id", T.normalize_subject(F.col("subject")).alias("subject"))


@query("tokenize", f"SELECT doc_id, len(regexp_extract_all(lower(text), {_sql_text(T.TOKEN)})) AS n, array_to_string(regexp_extract_all(lower(text), {_sql_text(T.TOKEN)}), ' ') AS tokens FROM documents")
def _(m, spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n"), F.array_join("ts", " ").alias("tokens"))


HASH = lambda c: f"substr(sha256(nullif({STRIP.format('regexp_replace(regexp_replace(regexp_replace(lower(' + c + '), ' + chr(39) + '\\s+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + 'sent from my [\\p{L}\\p{N}_]+' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + 'get outlook for [\\p{L}\\p{N}_]+' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '')), 1, 16)"


@query("body_hash_dedup", f"{MESSAGES} SELECT {HASH('body')} AS hash, count(*) AS n, min(message_id) AS first FROM messages GROUP BY 1")
def _(m, *_a):
    return m.groupBy(T.body_hash(F.col("body")).alias("hash")).agg(F.count("*").alias("n"), F.min("message_id").alias("first"))


@query("text_decode", "SELECT doc_id, text, CASE WHEN regexp_matches(text, '^[\\x00-\\xFF]*$') THEN text || chr(233) END AS latin FROM documents")
def _(m, spark, sf):
    """Every text from its UTF-8 bytes, and those that Latin-1 can hold from its bytes, which with an accent at the end aren't UTF-8."""
    latin = F.when(F.col("text").rlike(r"^[\x00-\xFF]*$"), T.decode_text(F.encode(F.concat("text", F.lit("é")), "ISO-8859-1")))
    return table(spark, sf, "documents").select("doc_id", T.decode_text(F.encode("text", "UTF-8")).alias("text"), latin.alias("latin"))


def _html_sql(links: bool) -> str:
    t = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<noscript\\b.*?</noscript>', ' ', 'g')"
    if links:
        t = f"regexp_replace({t}, '(?is)<a\\b[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', '[\\2](\\1)', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>|</?(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article|nav|header|footer)\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'")):
        t = f"replace({t}, '{name}', {char})"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"SELECT page_id, {STRIP.format('regexp_replace(' + t + ', ' + chr(39) + '\\n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM pages"


@query("html_to_text", _html_sql(True))
def _(m, spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("html_attachment", _html_sql(False))
def _(m, spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html"), False).alias("text"))


# --- calendar -------------------------------------------------------------------------------------

MEETINGS = "meetings AS (SELECT event_id, ts AS start, ts + to_minutes((event_id % 90)::INTEGER) AS end_at FROM events) "


def meetings(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("end"))


@query("meeting_range", f"WITH {MEETINGS} SELECT event_id FROM meetings WHERE start >= TIMESTAMP '2024-01-10' AND start < TIMESTAMP '2024-01-15'")
def _(m, spark, sf):
    return calendar.starting_within(meetings(spark, sf), "2024-01-10 00:00:00", "2024-01-15 00:00:00").select("event_id")


@query("meetings_by_date", f"WITH {MEETINGS} SELECT strftime(start, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id % 90)::BIGINT AS minutes FROM meetings GROUP BY 1")
def _(m, spark, sf):
    return calendar.by_date(meetings(spark, sf))


@query("business_day_horizon", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT day, list_filter(list_transform(range(1, 20), lambda i: (day + i::INTEGER)::DATE), lambda x: isodow(x) < 6)[5] AS fifth, list_filter(list_transform(range(1, 20), lambda i: (day + i::INTEGER)::DATE), lambda x: isodow(x) < 6)[1] AS next FROM d")
def _(m, spark, sf):
    return table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct().select("day", calendar.horizon(F.col("day"), 5).alias("fifth"), calendar.next_working_day(F.col("day")).alias("next"))
