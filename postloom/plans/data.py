"""Queries on stores, ingestion, retrieval, graphs, facts and prompts. Each has its SQL beside it."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from postloom.config import Config
from postloom.functions import filters
from postloom.functions import text as T
from postloom.functions.vectors import cosine
from postloom.operators import analytics, assist, chunks, context, facts, graph, ingest, keyword, phrases, retrieval, search, threads
from postloom.operators.ann import VectorIndex
from postloom.operators.daytable import DayTable
from postloom.operators.rollups import Rollups
from postloom.operators.substrings import TrigramIndex
from postloom.plans.feeds import _place
from postloom.plans.mail import CLEAN, DOC, HASH, OPEN, PACK, SEGMENT, STRIP, with_document
from postloom.plans.views import MESSAGES, NOW, messages, table
from postloom.sources import accounts

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(messages(spark, sf_dir), spark, sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


_MADE: dict = {}


def _once(spark, sf, name, make, of):
    """What `make(path)` writes of the table `of`, made once for each session and state of its files: an index is fitted once and asked often."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{of}.parquet")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    state = tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))
    key = spark.sparkContext.applicationId, sf, name
    if key not in _MADE or _MADE[key][0] != state:
        _MADE[key] = state, make(_place(spark, name))
    return _MADE[key][1]


# --- stores -------------------------------------------------------------------------------------


@query("attachment_eligible", "SELECT doc_id, (doc_id % 5 = 0) OR (doc_id % 3 = 1) AS ok FROM documents")
def _(m, spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", accounts.is_extractable(F.when(F.col("doc_id") % 5 == 0, "TEXT/plain").otherwise("application/octet-stream"), F.when(F.col("doc_id") % 3 == 1, "a.b.PDF").otherwise("noext")).alias("ok"))


@query("folder_tree", "WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 10 THEN p_partkey // 10 END AS parent, 'f' || p_partkey AS name FROM part), t AS (SELECT id, name AS path, 1 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name, t.depth + 1 FROM f JOIN t ON f.parent = t.id) SELECT * FROM t")
def _(m, spark, sf):
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 10 THEN p_partkey div 10 END").alias("parent"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"))
    return accounts.folder_paths(f, _place(spark, "folders"))


@query("folder_find", "WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 10 THEN p_partkey // 10 END AS parent, 'f' || (p_partkey % 7) AS name FROM part), t AS (SELECT id, name, name AS path, 1 AS depth, [name] AS steps FROM f WHERE parent IS NULL UNION ALL SELECT f.id, f.name, t.path || '/' || f.name, t.depth + 1, list_append(t.steps, f.name) FROM f JOIN t ON f.parent = t.id) SELECT upper(name) AS name, arg_min(id, (steps, id)) AS id, arg_min(path, (steps, id)) AS path FROM t GROUP BY 1")
def _(m, spark, sf):
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 10 THEN p_partkey div 10 END").alias("parent"), F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("name"))
    return accounts.find_folders(f, f.select(F.upper("name").alias("name")).distinct(), _place(spark, "folders"))


@query("point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 50, 999999)")
def _(m, spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id").isin(1, 5, 50, 999999)).select("doc_id", "lang")


@query("thread_fetch", f"{MESSAGES} SELECT message_id, date FROM messages WHERE conversation_id = 'c1'")
def _(m, *_a):
    return m.where("conversation_id = 'c1'").orderBy("date", "message_id").select("message_id", "date")


@query("insert_new_chunks", "SELECT min(doc_id) AS doc_id, md5(text) AS chunk_id FROM documents WHERE lang <> 'en' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY 2")
def _(m, spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("chunk_id"))
    return ingest.insert_new(d.where("lang = 'en'"), d.where("lang <> 'en'").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id")), "chunk_id").select("doc_id", "chunk_id")


@query("flag_update", f"{MESSAGES} SELECT message_id, CASE WHEN direction = 'sent' THEN true ELSE is_read END AS is_read, is_replied, CASE WHEN direction = 'sent' THEN NOT is_flagged ELSE is_flagged END AS is_flagged FROM messages")
def _(m, spark, sf):
    news = m.where("direction = 'sent'").select("message_id", F.lit(True).alias("is_read"), F.lit(None).cast("boolean").alias("is_replied"), (~F.col("is_flagged")).alias("is_flagged"))
    kept = DayTable.create(m.select("message_id", "is_read", "is_replied", "is_flagged", "date"), _place(spark, "flags"), "message_id")
    return kept.update_flags(news).read().drop("date")


@query("retention", f"{MESSAGES} SELECT message_id FROM messages WHERE date IS NULL OR date >= TIMESTAMP '{NOW}' - INTERVAL 10 DAYS")
def _(m, spark, sf):
    return DayTable.create(m.select("message_id", "date"), _place(spark, "kept"), "message_id").retain(NOW, 10).read().select("message_id")


@query("store_changes", f"{MESSAGES} SELECT CAST(date AS DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (CASE WHEN direction = 'sent' THEN NOT is_flagged ELSE is_flagged END) AS flagged FROM messages WHERE date >= TIMESTAMP '{NOW}' - INTERVAL '15 days 18 hours' AND folder <> 'Archive' GROUP BY 1")
def _(m, spark, sf):
    """Additions with repeats, changed flags, removals, retention in the middle of a day, and compaction, one after another."""
    rows = m.select("message_id", "is_read", "is_replied", "is_flagged", "direction", "folder", "date")
    news = rows.where("direction = 'sent'").select("message_id", F.lit(None).cast("boolean").alias("is_read"), F.lit(None).cast("boolean").alias("is_replied"), (~F.col("is_flagged")).alias("is_flagged"))
    made = DayTable.create(rows.where("folder <> 'INBOX'"), _place(spark, "changes"), "message_id").insert(rows)
    changed = made.update_flags(news).remove(rows.where("folder = 'Archive'")).retain("2024-01-25 06:00:00", 16).compact()
    return changed.read().groupBy(F.col("date").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if("is_flagged").alias("flagged"))


@query("debug_sample", "SELECT doc_id, substr(text, 1, 500) AS text FROM documents ORDER BY doc_id LIMIT 7")
def _(m, spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").limit(7).select("doc_id", F.substring("text", 1, 500).alias("text"))


@query("store_count", "SELECT count(*) AS n FROM documents")
def _(m, spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


# --- ingestion ----------------------------------------------------------------------------------

SEEN = f"keyed AS (SELECT *, substr(sha256(message_id), 1, 32) AS mid, {HASH('body')} AS bh FROM messages), seen AS (SELECT mid, bh, CASE WHEN folder = 'Projects' THEN NOT is_read ELSE is_read END AS r, is_replied AS p, is_flagged AS f FROM keyed WHERE direction = 'sent'), news AS (SELECT k.*, CASE WHEN s.mid IS NOT NULL THEN CASE WHEN s.r <> k.is_read OR s.p <> k.is_replied OR s.f <> k.is_flagged THEN 'changed' ELSE 'duplicate' END WHEN EXISTS (SELECT 1 FROM seen x WHERE x.bh = k.bh) THEN 'duplicate' ELSE 'new' END AS status FROM keyed k LEFT JOIN seen s ON s.mid = k.mid) "


def _seen(m):
    keyed = ingest.with_keys(m)
    seen = keyed.where("direction = 'sent'").select("mid_hash", "body_hash", F.when(F.col("folder") == "Projects", ~F.col("is_read")).otherwise(F.col("is_read")).alias("is_read"), "is_replied", "is_flagged")
    return keyed, seen


@query("check_email_status", f"{MESSAGES[:-1]}, {SEEN} SELECT message_id, status FROM news")
def _(m, *_a):
    return ingest.classify(*_seen(m)).select("message_id", "status")


@query("is_duplicate", f"{MESSAGES[:-1]}, {SEEN} SELECT message_id, status <> 'new' AS known FROM news")
def _(m, *_a):
    return ingest.classify(*_seen(m)).select("message_id", (F.col("status") != "new").alias("known"))


@query("mark_seen", f"{MESSAGES[:-1]}, {SEEN} SELECT mid AS mid_hash FROM seen UNION SELECT mid FROM keyed")
def _(m, *_a):
    keyed, seen = _seen(m)
    return ingest.mark_seen(seen, keyed).select("mid_hash")


@query("ingest_counters", f"{MESSAGES[:-1]}, {SEEN} SELECT count(*) AS found, count(*) FILTER (status = 'new') AS added, count(*) FILTER (status = 'duplicate') AS skipped, count(*) FILTER (status = 'changed') AS updated, max(date) FILTER (status = 'new') AS newest FROM news")
def _(m, *_a):
    return ingest.counters(ingest.classify(*_seen(m)))


@query("within_input_dedup", f"{MESSAGES[:-1]}, keyed AS (SELECT message_id, {HASH('body')} AS bh FROM messages) SELECT min(message_id) AS message_id FROM keyed WHERE bh IS NOT NULL GROUP BY bh UNION ALL SELECT message_id FROM keyed WHERE bh IS NULL")
def _(m, *_a):
    return ingest.first_of_each(ingest.with_keys(m), F.col("message_id")).select("message_id")


WATER = "o AS (SELECT 'u' || user_id AS account_id, max(ts) AS at, max(ts) AS d, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), n AS (SELECT 'u' || user_id AS account_id, max(ts) AS at, min(ts) AS d, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1), merged AS (SELECT coalesce(o.account_id, n.account_id) AS account_id, greatest(o.at, n.at) AS last_sync_at, greatest(o.d, n.d) AS last_message_date, coalesce(o.n, 0) + coalesce(n.n, 0) AS messages_synced, CASE WHEN n.account_id IS NULL THEN 'completed' ELSE 'syncing' END AS status FROM o FULL JOIN n ON o.account_id = n.account_id) "


def _water(spark, sf):
    e = table(spark, sf, "events").withColumn("account_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    old = e.where("ts < timestamp_ntz'2024-01-10 00:00:00'").groupBy("account_id").agg(F.max("ts").alias("last_sync_at"), F.max("ts").alias("last_message_date"), F.count("*").alias("messages_synced"), F.lit("completed").alias("status"))
    new = e.where("ts >= timestamp_ntz'2024-01-10 00:00:00'").groupBy("account_id").agg(F.max("ts").alias("last_sync_at"), F.min("ts").alias("last_message_date"), F.count("*").alias("messages_synced"), F.lit("syncing").alias("status"))
    return ingest.merge_watermarks(old, new)


@query("watermark_merge", f"WITH {WATER} SELECT * FROM merged")
def _(m, spark, sf):
    return _water(spark, sf)


@query("watermark_list", f"WITH {WATER} SELECT account_id, last_sync_at FROM merged ORDER BY last_sync_at DESC, account_id LIMIT 20")
def _(m, spark, sf):
    return _water(spark, sf).orderBy(F.desc("last_sync_at"), "account_id").limit(20).select("account_id", "last_sync_at")


@query("incremental_since", f"WITH {WATER} SELECT account_id, greatest(TIMESTAMP '2024-01-28', last_message_date - INTERVAL 1 HOUR) AS since FROM merged")
def _(m, spark, sf):
    return _water(spark, sf).select("account_id", ingest.since(F.col("last_message_date"), F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")).alias("since"))


@query("incremental_run", f"WITH {WATER} SELECT e.event_id FROM events e JOIN merged w ON w.account_id = 'u' || e.user_id WHERE e.ts >= greatest(TIMESTAMP '2024-01-01', w.last_message_date - INTERVAL 1 HOUR)")
def _(m, spark, sf):
    w = _water(spark, sf).select("account_id", ingest.since(F.col("last_message_date"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("since"))
    e = table(spark, sf, "events").withColumn("account_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.join(w, "account_id").where("ts >= since").select("event_id")


@query("two_phase_first_run", f"{MESSAGES} SELECT message_id, CASE WHEN date >= TIMESTAMP '{NOW}' - INTERVAL 14 DAYS THEN 'priority' ELSE 'backfill' END AS phase FROM messages WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 20 DAYS")
def _(m, *_a):
    return ingest.two_phase(m, NOW, 14, 20).select("message_id", "phase")


@query("seen_cleanup", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 15 DAYS")
def _(m, spark, sf):
    return ingest.retain(table(spark, sf, "events"), NOW, 15, "ts").select("event_id")


RUNS = "runs AS (SELECT event_id AS run_id, user_id % 9 AS account, event_id % 7 AS messages_new, event_id % 4 AS messages_skipped, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events) "


def _runs(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 9).alias("account"), (F.col("event_id") % 7).alias("messages_new"), (F.col("event_id") % 4).alias("messages_skipped"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("completed").alias("status"))


@query("sync_log_complete", f"WITH {RUNS} SELECT run_id, CASE WHEN status = 'failed' THEN 'started' ELSE status END AS status FROM runs")
def _(m, spark, sf):
    r = _runs(spark, sf)
    log = r.select("run_id", F.lit(0).alias("seq"), F.lit("started").alias("status")).unionByName(r.where("status <> 'failed'").select("run_id", F.lit(1).alias("seq"), "status"))
    return ingest.close_log(log).select("run_id", "status")


@query("sync_history", f"WITH {RUNS} SELECT * FROM runs WHERE account = 3 ORDER BY run_id DESC LIMIT 12")
def _(m, spark, sf):
    return ingest.rank_latest(_runs(spark, sf).where("account = 3"), 12, "run_id")


@query("sync_stats", f"WITH {RUNS} SELECT (SELECT count(DISTINCT user_id) FROM events) AS accounts, (SELECT count(*) FROM conversations) AS seen, count(*) AS total_runs, coalesce(sum(messages_new) FILTER (status = 'completed'), 0)::BIGINT AS total_new, coalesce(sum(messages_skipped) FILTER (status = 'completed'), 0)::BIGINT AS total_skipped FROM runs")
def _(m, spark, sf):
    return ingest.sync_stats(table(spark, sf, "events").select("user_id").distinct(), m, _runs(spark, sf))


@query("unextracted", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(m, spark, sf):
    return facts.unextracted(table(spark, sf, "documents").withColumnRenamed("doc_id", "message_id"), table(spark, sf, "labels").withColumnRenamed("doc_id", "email_id")).select(F.col("message_id").alias("doc_id"))


# --- chunks --------------------------------------------------------------------------------------



_PACKED = PACK.format("text", 800).replace("{{", "{").replace("}}", "}")
CHUNKS = (
    f"{SEGMENT[:-1]}, p AS (SELECT seg.message_id, seg.subject, b.turn, 'Subject: ' || seg.subject || chr(10) || chr(10) || b.body || CASE WHEN b.turn = 2 THEN chr(10) || '[Attachment: notes.txt]' || chr(10) || 'Of the file: ' || b.body ELSE '' END AS doc, {STRIP.format(f'CASE WHEN {CLEAN(chr(102))} <> {chr(39)}{chr(39)} THEN {chr(39)}Subject: {chr(39)} || seg.subject || chr(10) || chr(10) || {CLEAN(chr(102))} ELSE {chr(39)}Subject: {chr(39)} || seg.subject END')} AS fresh, {CLEAN('q')} AS quoted, {STRIP.format(chr(39) + 'Of the file: ' + chr(39) + ' || b.body')} AS file FROM seg JOIN messages b ON b.message_id = seg.message_id), "
    "t AS (SELECT message_id, 'fresh' AS kind, '_fresh' AS one, '_f' AS more, '' AS head, fresh AS text FROM p WHERE length(fresh) >= 50 UNION ALL SELECT message_id, 'quoted', '_quoted', '_q', '', 'Subject: ' || subject || chr(10) || '[Quoted history]' || chr(10) || chr(10) || quoted FROM p WHERE length(quoted) >= 50 UNION ALL SELECT message_id, 'attachment', '_att0', '_att0_', 'Subject: ' || subject || chr(10) || '[Attachment: notes.txt]' || chr(10) || chr(10), file FROM p WHERE turn = 2 AND length(file) >= 50 "
    f"UNION ALL SELECT message_id, 'fresh', '_fresh', '_f', '', k FROM (SELECT *, {CLEAN('doc')} AS k FROM p) WHERE length(fresh) < 50 AND length(quoted) < 50 AND NOT (turn = 2 AND length(file) >= 50) AND length(k) >= 50), "
    f"r AS (SELECT *, {_PACKED} AS r FROM t), c AS (SELECT *, CASE WHEN length(text) <= 800 THEN [text] WHEN {STRIP.format('r.now')} <> '' THEN list_append(r.done, {STRIP.format('r.now')}) ELSE r.done END AS cs FROM r) "
    "SELECT message_id || CASE WHEN i = 1 THEN one ELSE more || (i - 1) END AS chunk_id, kind, i - 1 AS chunk_index, head || cs[i] AS text FROM c, unnest(range(1, len(cs) + 1)) u(i)"
)


def _chunks(m):
    file = F.when(F.col("turn") == 2, F.concat(F.lit("\n[Attachment: notes.txt]\nOf the file: "), "body")).otherwise("")
    rows = m.select(F.col("message_id").alias("email_id"), "subject", F.concat(F.lit("Subject: "), "subject", F.lit("\n\n"), "body", file).alias("document"))
    return chunks.chunk(rows)


@query("email_chunks", CHUNKS)
def _(m, *_a):
    return _chunks(m).select("chunk_id", "kind", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query("chunk_sizes", f"SELECT kind, count(*) AS n, max(chunk_index) AS last, count(DISTINCT chunk_id) AS ids, sum(length(text))::BIGINT AS chars FROM ({CHUNKS}) GROUP BY 1")
def _(m, *_a):
    return _chunks(m).groupBy("kind").agg(F.count("*").alias("n"), F.max("chunk_index").cast("long").alias("last"), F.count_distinct("chunk_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


LINE = f"coalesce(substr(list_filter(list_transform(string_split(body, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:From|To|Subject|Date|Folder):') AND NOT starts_with(x, '>'))[1], 1, 120), '')"
SUMMARY = f"{MESSAGES[:-1]}, r AS (SELECT *, coalesce(nullif(sender_name, ''), sender) AS name, {LINE} AS line FROM messages WHERE conversation_id <> ''), g AS (SELECT conversation_id, count(*) AS message_count, 'Thread: ' || arg_max(subject, (date, message_id)) || chr(10) || 'Messages: ' || count(*) || chr(10) || 'Period: ' || strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') || chr(10) || 'Participants: ' || array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 8), ', ') || chr(10) || chr(10) || 'Timeline:' || chr(10) || string_agg('  [' || strftime(date, '%Y-%m-%dT%H:%M') || '] ' || CASE WHEN direction = 'sent' THEN 'SENT' ELSE 'RECV' END || ' ' || name || ': ' || line, chr(10) ORDER BY date, message_id) AS text FROM r GROUP BY 1 HAVING count(*) >= 2) "


@query("thread_summary", f"{SUMMARY} SELECT conversation_id, substr(sha256('thread_summary_' || conversation_id), 1, 32) AS chunk_id, message_count, substr(text, 1, 1200) AS text FROM g")
def _(m, *_a):
    return chunks.summaries(m)


@query("add_thread_summaries", f"{SUMMARY} SELECT conversation_id FROM g WHERE message_count <= 4")
def _(m, *_a):
    every = chunks.summaries(m)
    return ingest.insert_new(every.where("message_count > 4"), every, "chunk_id").select("conversation_id")


# --- retrieval ----------------------------------------------------------------------------------

QUERY_VEC = [round(((i * 37) % 64 - 31.5) / 150, 6) for i in range(64)]
_VEC = "[" + ", ".join(map(str, QUERY_VEC)) + "]::DOUBLE[]"
KNN = f"scored AS (SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC}), 6) AS relevance FROM embeddings) "
_TOP = "SELECT id, round(1 - relevance, 6) AS distance, relevance FROM scored {0} ORDER BY relevance DESC, id LIMIT {1}"
ASK = "the that ation of the and de la"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query("knn_exact", f"WITH {KNN} {_TOP.format('', 10)}")
def _(m, spark, sf):
    return search.knn(_vectors(spark, sf), QUERY_VEC, 10, key="vec_id")


@query("knn_filtered", f"WITH {KNN} {_TOP.format('WHERE label = 3', 10)}")
def _(m, spark, sf):
    return search.knn(_vectors(spark, sf), QUERY_VEC, 10, F.col("label") == 3, key="vec_id")


@query("knn_filter_fallback", f"WITH {KNN} {_TOP.format('', 10)}")
def _(m, spark, sf):
    return search.knn_or_all(_vectors(spark, sf), QUERY_VEC, 10, F.col("label") == 77, key="vec_id")


BM25 = (
    f"toks AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '{T.TOKEN}') AS ts FROM documents), sizes AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM toks), "
    "posts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT doc_id, len(ts) AS doc_len, unnest(ts) AS term FROM toks) GROUP BY 1, 2), "
    "rawidf AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM sizes) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY term), "
    "idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf), "
    f"asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower('{ASK}'), '{T.TOKEN}')) AS term) GROUP BY 1), "
    "bm AS (SELECT p.doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len)))), 6) AS score FROM posts p JOIN idf USING (term) JOIN asked USING (term), sizes GROUP BY 1 HAVING round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len)))), 6) > 0) "
)


def _index(spark, sf) -> keyword.Index:
    return _once(spark, sf, "index", lambda path: keyword.Index.build(table(spark, sf, "documents"), path), "documents")


#: Statistics of all terms, by a hash of the term: as many rows as the driver's compare takes in its stride.
BY_TERM = "SELECT substr(md5(term), 1, 2) AS bucket, count(*) AS terms, sum(df)::BIGINT AS df, round(sum(idf), 4) AS idf, sum((SELECT sum(tf)::BIGINT FROM posts p WHERE p.term = idf.term))::BIGINT AS tokens FROM idf GROUP BY 1"


#: Statistics of each term.
OF_TERMS = "SELECT term, df, round(idf, 6) AS idf, tokens FROM idf JOIN (SELECT term, sum(tf)::BIGINT AS tokens FROM posts GROUP BY 1) USING (term)"


def _terms(index: keyword.Index):
    return index.terms.join(index.postings.groupBy("term").agg(F.sum("tf").alias("tokens")), "term")


def _of_terms(index: keyword.Index):
    return _terms(index).select("term", "df", F.round("idf", 6).alias("idf"), "tokens")


def _by_term(index: keyword.Index):
    bucket = F.substring(F.md5(F.col("term").cast("binary")), 1, 2).alias("bucket")
    return _terms(index).groupBy(bucket).agg(F.count("*").alias("terms"), F.sum("df").alias("df"), F.round(F.sum("idf"), 4).alias("idf"), F.sum("tokens").alias("tokens"))


@query("bm25_term_stats", f"WITH {BM25} {OF_TERMS}")
def _(m, spark, sf):
    return _of_terms(_index(spark, sf))


@query("bm25_search", f"WITH {BM25} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def _(m, spark, sf):
    return keyword.bm25(_index(spark, sf), ASK, 50)


@query("bm25_filtered", f"WITH {BM25} SELECT bm.* FROM bm JOIN documents d USING (doc_id) WHERE d.lang = 'en' ORDER BY score DESC, doc_id LIMIT 20")
def _(m, spark, sf):
    return keyword.bm25(_index(spark, sf), ASK, 20, table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")))


@query("bm25_incremental", f"WITH {BM25} {OF_TERMS}")
def _(m, spark, sf):
    """An index of some documents, and then of all: the second addition is a segment of its own."""
    d = table(spark, sf, "documents")
    return _of_terms(keyword.Index.build(d.where("lang in ('en', 'fr')"), _place(spark, "index")).add(d))


LIVE = BM25.replace("FROM documents)", "FROM documents WHERE lang <> 'fr')")


@query("bm25_removed", f"WITH {LIVE} {BY_TERM}")
def _(m, spark, sf):
    """Added in three parts, of which some documents are removed again before all becomes one segment."""
    d = table(spark, sf, "documents")
    index = keyword.Index.build(d.where("lang = 'en'"), _place(spark, "index")).add(d.where("lang in ('fr', 'de')"))
    return _by_term(index.remove(d.where("lang = 'fr'")).add(d.where("lang <> 'fr'")).compact(whole=True))


@query("bm25_removed_search", f"WITH {LIVE} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 30")
def _(m, spark, sf):
    """A question to an index with tombstones."""
    index = _once(spark, sf, "index_removed", lambda path: keyword.Index.build(table(spark, sf, "documents"), path).remove(table(spark, sf, "documents").where("lang = 'fr'")), "documents")
    return keyword.bm25(index, ASK, 30)


HYBRID = f"{KNN}, {BM25[:-1]}, near AS (SELECT id, relevance, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM (SELECT * FROM scored ORDER BY relevance DESC, id LIMIT 40)), words AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 40)), fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score FROM (SELECT id, rank FROM near UNION ALL SELECT id, rank FROM words) GROUP BY id), hy AS (SELECT f.id, rrf_score::DOUBLE AS rrf_score, coalesce(n.relevance, 0.5) AS relevance FROM fused f LEFT JOIN near n ON n.id = f.id) "


def _lists(spark, sf):
    return search.knn(_vectors(spark, sf), QUERY_VEC, 40, key="vec_id"), keyword.bm25(_index(spark, sf), ASK, 40)


@query("rrf", f"WITH {HYBRID} SELECT id, rrf_score FROM hy")
def _(m, spark, sf):
    near, words = _lists(spark, sf)
    return search.fuse([search.ranked(near, "relevance", "id"), search.ranked(words, "score", "doc_id")])


@query("hybrid_search", f"WITH {HYBRID} SELECT * FROM hy ORDER BY rrf_score DESC, id LIMIT 10")
def _(m, spark, sf):
    return search.hybrid(*_lists(spark, sf), 10)


OVERLAP = f"SELECT doc_id AS id, round(len(list_intersect(q, d)) / greatest(len(list_distinct(list_concat(q, d))), 1), 6) AS rerank_score FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower('{ASK}'), '{T.TOKEN}')) AS q, list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')) AS d FROM documents)"


@query("rerank_overlap", f"{OVERLAP} ORDER BY rerank_score DESC, id LIMIT 10")
def _(m, spark, sf):
    return search.rerank(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), ASK, 10).select("id", "rerank_score")


HITS = f"{MESSAGES[:-1]}, hits AS (SELECT message_id, conversation_id, row_number() OVER (ORDER BY date DESC, message_id) AS rank FROM messages WHERE direction = 'sent' AND contains(lower(subject), 'th') ORDER BY date DESC, message_id LIMIT 15) "


def _hits(m):
    """The 15 latest sent messages whose subject holds the words looked for, as a search gives them."""
    top = m.where("direction = 'sent'").where(F.contains(F.lower("subject"), F.lit("th"))).orderBy(F.desc("date"), "message_id").limit(15)
    return search.ranked(top, "date", "message_id").withColumnRenamed("id", "message_id").join(top.select("message_id", "conversation_id"), "message_id")


@query("thread_expansion", f"{HITS} SELECT message_id FROM messages WHERE (conversation_id <> '' AND conversation_id IN (SELECT conversation_id FROM hits)) OR (conversation_id = '' AND message_id IN (SELECT message_id FROM hits))")
def _(m, *_a):
    return search.expand_threads(m, _hits(m)).select("message_id")


@query("partial_expansion", f"{HITS}, tops AS (SELECT * FROM hits WHERE rank <= (SELECT count(*) // 2 + 1 FROM hits)) SELECT message_id FROM messages WHERE (conversation_id <> '' AND conversation_id IN (SELECT conversation_id FROM tops)) OR message_id IN (SELECT message_id FROM hits)")
def _(m, *_a):
    return search.expand_some(m, _hits(m)).select("message_id")


@query("multi_query_union", "WITH l AS (SELECT * FROM (SELECT 1 AS query_no, doc_id AS id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 2, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 3, doc_id, row_number() OVER (ORDER BY doc_id DESC) FROM documents ORDER BY doc_id DESC LIMIT 5)) SELECT id, arg_min(query_no, (query_no, rank)) AS query_no, arg_min(rank, (query_no, rank)) AS rank FROM l GROUP BY id")
def _(m, spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    best = lambda rows, by, n, no: search.ranked(rows.orderBy(F.desc(by), "doc_id").limit(n), by, "doc_id").withColumn("query_no", F.lit(no))
    return search.first_appearance(best(d.where("lang = 'en'"), "doc_id", 10, 1).unionByName(best(d, "n_chars", 5, 2)).unionByName(best(d, "doc_id", 5, 3)))


def _cells(spark, sf) -> VectorIndex:
    vectors = _vectors(spark, sf).select(F.col("vec_id").alias("id"), "embedding")
    return _once(spark, sf, "cells", lambda path: VectorIndex.fit(vectors, path), "embeddings")


def _some(spark, sf):
    """The vectors that ask: those whose id is divisible by 20."""
    return _vectors(spark, sf).select(F.col("vec_id").alias("id"), "embedding").where("id % 20 = 0")


@query("knn_approximate", None)
def _(m, spark, sf):
    """The ten nearest of every vector whose id is divisible by 20, among all."""
    return _cells(spark, sf).search(_some(spark, sf), 10)


UNITS = "u AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), pairs AS MATERIALIZED (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS relevance FROM u a, u b WHERE a.id % 20 = 0), nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS place FROM pairs QUALIFY place <= 10) "


@query("knn_all_cells", f"WITH {UNITS} SELECT * FROM nearest")
def _(m, spark, sf):
    """The same, with all cells looked into and all vectors compared exactly: no neighbour is missed."""
    return _cells(spark, sf).search_all(_some(spark, sf), 10)


@query("knn_recall", f"WITH {UNITS} SELECT query_id, 10 AS found_at_most, true AS scores_are_exact FROM nearest GROUP BY 1")
def _(m, spark, sf):
    """Of each query of knn_approximate: whether what it found has its exact score, and that it found no more than ten."""
    found, v = _cells(spark, sf).search(_some(spark, sf), 10), _vectors(spark, sf)
    of = lambda name: v.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"{name}_v"))
    exact = F.abs(F.col("relevance") - cosine(F.col("query_id_v"), F.col("id_v"))) < 1e-5
    return found.join(of("query_id"), "query_id").join(of("id"), "id").groupBy("query_id").agg(F.greatest(F.count("*"), F.lit(10)).cast("int").alias("found_at_most"), F.bool_and(exact).alias("scores_are_exact"))


#: A question whose wording filters, asked of documents with a direction and flags.
QUESTION = f"unread {ASK}"
ASKED_OF = "asked_of AS (SELECT doc_id AS id, text AS document, CASE WHEN doc_id % 3 = 0 THEN 'sent' ELSE 'received' END AS direction, doc_id % 2 = 0 AS is_read FROM documents) "
RETRIEVED = (
    f"{KNN}, {BM25.replace(ASK, QUESTION)[:-1]}, {ASKED_OF[:-1]}, kept AS (SELECT id FROM asked_of WHERE NOT is_read AND direction = 'received'), "
    "near AS (SELECT id, relevance, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM (SELECT s.* FROM scored s JOIN kept USING (id) ORDER BY relevance DESC, id LIMIT 40)), "
    "words AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT bm.* FROM bm JOIN kept ON kept.id = bm.doc_id ORDER BY score DESC, doc_id LIMIT 40)), "
    "fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS rrf_score FROM (SELECT id, rank FROM near UNION ALL SELECT id, rank FROM words) GROUP BY id), "
    f"scored_all AS (SELECT f.id, rrf_score, coalesce(n.relevance, 0.5) AS relevance, round(len(list_intersect(q, d)) / greatest(len(list_distinct(list_concat(q, d))), 1), 6) AS rerank_score FROM fused f LEFT JOIN near n USING (id) JOIN (SELECT id, list_distinct(regexp_extract_all(lower('{QUESTION}'), '{T.TOKEN}')) AS q, list_distinct(regexp_extract_all(lower(document), '{T.TOKEN}')) AS d FROM asked_of) a USING (id)), "
    "best AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, rrf_score DESC, id) AS place FROM scored_all ORDER BY place LIMIT 10) "
)


def _asked_of(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), F.when(F.col("doc_id") % 3 == 0, "sent").otherwise("received").alias("direction"), (F.col("doc_id") % 2 == 0).alias("is_read"))
    return retrieval.Corpus(d, _vectors(spark, sf).withColumnRenamed("vec_id", "id"), _index(spark, sf))


def _retrieved(spark, sf, **settings):
    return retrieval.retrieve(_asked_of(spark, sf), QUESTION, QUERY_VEC, 10, retrieval.question_where(QUESTION, filters.datetime.fromisoformat(NOW)), **settings)


@query("retrieval", f"WITH {RETRIEVED} SELECT * FROM best")
def _(m, spark, sf):
    return _retrieved(spark, sf)


@query("relevance_threshold", f"WITH {RETRIEVED} SELECT id, relevance FROM best WHERE relevance > 0.45")
def _(m, spark, sf):
    return _retrieved(spark, sf, above=retrieval.THRESHOLDS["entity_map"]).select("id", "relevance")


@query("rerank_model", f"WITH {RETRIEVED} SELECT id, length(substr(document, 1, 1500))::DOUBLE AS rerank_score FROM scored_all JOIN asked_of USING (id) ORDER BY rerank_score DESC, rrf_score DESC, id LIMIT 10")
def _(m, spark, sf):
    """A model that likes long texts."""
    return _retrieved(spark, sf, model=lambda: lambda question, texts: [float(len(t)) for t in texts]).select("id", "rerank_score")


#: Vectors of the standing questions, and of messages: those of the test table, in turn.
STANDING = {k: [round(((i * (37 + 2 * n)) % 64 - 31.5) / 150, 6) for i in range(64)] for n, k in enumerate(retrieval.QUESTIONS)}


def _near_sql(name: str, kind: str, where: str, n: int) -> str:
    vector = "[" + ", ".join(map(str, STANDING[kind])) + "]::DOUBLE[]"
    return f"{name} AS (SELECT * FROM (SELECT m.*, round(list_cosine_similarity(e.embedding::DOUBLE[], {vector}), 6) AS relevance FROM messages m JOIN embeddings e ON e.vec_id = (m.conv_id * 8 + m.turn) % 500 WHERE {where}) ORDER BY relevance DESC, message_id LIMIT {n}) "


def _message_vectors(m, spark, sf):
    """id, embedding of messages. Both sides are shuffled: were messages sent to the vectors, the file of the few that match would give one task all the work."""
    wanted = m.select(F.col("message_id").alias("id"), ((F.col("conv_id") * 8 + F.col("turn")) % 500).alias("vec_id"))
    return wanted.hint("merge").join(_vectors(spark, sf), "vec_id").select("id", "embedding")


def _mailbox(m, spark, sf):
    return retrieval.Corpus(m.withColumnRenamed("message_id", "id"), _message_vectors(m, spark, sf))


STATS_OF = MESSAGES + "SELECT count(*) AS total, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction <> 'sent') AS received, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_flagged) AS flagged FROM messages WHERE {}"
STATS = "SELECT count(*) AS total, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction <> 'sent') AS received, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_flagged) AS flagged FROM messages"


@query("inbox_summary", f"{MESSAGES[:-1]}, {_near_sql('a', 'action_needed', chr(39).join(('direction = ', 'received', ' AND NOT is_replied')), 5)[:-1]}, {_near_sql('b', 'awaiting_response', chr(39).join(('direction = ', 'sent', ' AND NOT is_replied')), 5)[:-1]}, s AS ({STATS}) SELECT h.*, s.* FROM (SELECT 'action_needed' AS kind, message_id, sender AS who, subject, date FROM a UNION ALL SELECT 'awaiting_response', message_id, recipient1, subject, date FROM b) h, s")
def _(m, spark, sf):
    hits = retrieval.summary_hits(_mailbox(m, spark, sf), STANDING)
    who = F.when(F.col("kind") == "action_needed", F.col("sender")).otherwise(F.split_part(F.concat_ws(",", "recipient1", "recipient2"), F.lit(","), F.lit(1)))
    rows = m.join(F.broadcast(hits.withColumnRenamed("id", "message_id")), "message_id").select("kind", "message_id", who.alias("who"), "subject", "date")
    return rows.join(F.broadcast(analytics.mailbox_stats(m)))


TASKS = f"{OPEN[:-1]}, {_near_sql('dh', 'deadline', chr(39).join(('direction = ', 'received', ' AND NOT is_replied')), 10)[:-1]}, {_near_sql('qh', 'question', chr(39).join(('direction = ', 'received', ' AND NOT is_replied')), 10)[:-1]}, tagged AS (SELECT message_id, subject, array_to_string(list_filter([CASE WHEN subject IN (SELECT subject FROM dh) THEN 'deadline' END, CASE WHEN subject IN (SELECT subject FROM qh) THEN 'question' END], lambda x: x IS NOT NULL), ',') AS tags FROM open WHERE bucket = 'needs_action') "


def _tasks(m, spark, sf):
    hits = {k: h.select(F.col("id").alias("message_id")).join(m.select("message_id", "subject"), "message_id") for k, h in retrieval.task_hits(_mailbox(m, spark, sf), STANDING).items()}
    buckets = threads.buckets(m, NOW)
    return buckets, threads.tagged_tasks(buckets, hits["deadline"], hits["question"])


@query("tasks_tagged", f"{TASKS} SELECT * FROM tagged")
def _(m, spark, sf):
    return _tasks(m, spark, sf)[1].select("message_id", "subject", "tags")


@query("task_counts", f"{TASKS} SELECT (SELECT count(*) FROM open) AS total_open, count(*) FILTER (bucket = 'needs_action') AS needs_action, count(*) FILTER (bucket = 'awaiting_response') AS awaiting_response, count(*) FILTER (bucket = 'stale') AS stale, (SELECT count(*) FROM tagged WHERE contains(tags, 'deadline')) AS with_deadlines, (SELECT count(*) FROM tagged WHERE contains(tags, 'question')) AS with_questions FROM open")
def _(m, spark, sf):
    return threads.task_counts(*_tasks(m, spark, sf))


# --- rollups --------------------------------------------------------------------------------------


def _rollups(m, spark):
    """Of two batches; the second comes twice and counts once."""
    made, rows = Rollups(spark, _place(spark, "rollups")), m.withColumn("recipients", F.array("recipient1", "recipient2"))
    for batch, where in (("a", "conv_id % 2 = 0"), ("b", "conv_id % 2 = 1"), ("b", "conv_id % 2 = 1")):
        made.add(rows.where(where), batch)
    return made


@query("rollup_stats", STATS_OF.format("date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-20'"))
def _(m, spark, sf):
    return _rollups(m, spark).stats(F.col("day").between("2024-01-05", "2024-01-19"))


@query("rollup_volume", f"{MESSAGES} SELECT date::DATE AS day, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction <> 'sent') AS received FROM messages GROUP BY 1")
def _(m, spark, sf):
    return _rollups(m, spark).volume()


@query("rollup_top_senders", f"{MESSAGES} SELECT coalesce(nullif(sender_name, ''), sender) AS name, count(*) AS n FROM messages WHERE direction = 'received' AND date >= TIMESTAMP '2024-01-05' GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def _(m, spark, sf):
    return _rollups(m, spark).top("sender", 10, F.col("day") >= "2024-01-05")


@query("rollup_threads", f"{MESSAGES} SELECT count(DISTINCT nullif(conversation_id, '')) AS n, true AS estimate_is_close FROM messages")
def _(m, spark, sf):
    """Exactly, and whether the united sketches come within five per cent of it."""
    made = _rollups(m, spark)
    return made.threads().join(made.threads(exact=False).select(F.col("n").alias("about"))).select("n", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n")).alias("estimate_is_close"))


# --- from a question, a topic or a meeting, in one call ------------------------------------------


def _embed(question: str) -> list[float]:
    """A stand-in for an embedding model."""
    return [round(((i * (37 + 2 * (len(question) % 13))) % 64 - 31.5) / 150, 6) for i in range(64)]


def _mail(m, spark, sf):
    """The messages, written once: a search reads them several times, and each would make the view's joins again."""

    def write(path):
        m.write.parquet(path)
        return path

    return spark.read.parquet(_once(spark, sf, "mail", write, "conversations"))


def _box(m, spark, sf) -> assist.Mailbox:
    m = _mail(m, spark, sf)
    index = _once(spark, sf, "mail_index", lambda path: keyword.Index.build(m.select("message_id", "body"), path, "message_id", "body"), "conversations")
    return assist.Mailbox(m, retrieval.Corpus(m.select(F.col("message_id").alias("id"), F.col("body").alias("document"), "direction", "is_replied", "is_read", "date"), _message_vectors(m, spark, sf), index), _embed)


def _search_sql(name: str, question: str, n: int, where: str = "true", rerank: bool = True, above: float = -9) -> str:
    """hits_<name> (id, relevance, place) of one search over the messages; after MAIL_WORDS."""
    many, vector = min(4 * n, 50), "[" + ", ".join(map(str, _embed(question))) + "]::DOUBLE[]"
    words = f"regexp_extract_all(lower('{question}'), '{T.TOKEN}')"
    score = "round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len)))), 6)"
    overlap = f"round(len(list_intersect(list_distinct({words}), list_distinct(ts))) / greatest(len(list_distinct(list_concat({words}, ts))), 1), 6)" if rerank else "NULL"
    return (
        f"near_{name} AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM (SELECT message_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], {vector}), 6) AS relevance FROM messages m JOIN embeddings e ON e.vec_id = (m.conv_id * 8 + m.turn) % 500 WHERE {where} ORDER BY relevance DESC, id LIMIT {many})), "
        f"words_{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT p.id, {score} AS score FROM posts p JOIN idf USING (term) JOIN (SELECT term, count(*) AS times FROM (SELECT unnest({words}) AS term) GROUP BY 1) USING (term), sizes WHERE p.id IN (SELECT message_id FROM messages WHERE {where}) GROUP BY 1 HAVING {score} > 0 ORDER BY score DESC, id LIMIT {many})), "
        f"fused_{name} AS (SELECT id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS rrf FROM (SELECT id, rank FROM near_{name} UNION ALL SELECT id, rank FROM words_{name}) GROUP BY id), "
        f"hits_{name} AS (SELECT * FROM (SELECT f.id, coalesce(r.relevance, 0.5) AS relevance, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FROM fused_{name}) > {n} THEN {overlap} END DESC NULLS LAST, rrf DESC, f.id) AS place FROM fused_{name} f LEFT JOIN near_{name} r USING (id) JOIN toks t ON t.id = f.id) WHERE place <= {n} AND relevance > {above}), "
    )


MAIL_WORDS = (
    f"{MESSAGES[:-1]}, toks AS MATERIALIZED (SELECT message_id AS id, regexp_extract_all(lower(body), '{T.TOKEN}') AS ts FROM messages), sizes AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM toks), "
    "posts AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT id, len(ts) AS doc_len, unnest(ts) AS term FROM toks) GROUP BY 1, 2), rawidf AS MATERIALIZED (SELECT term, ln((SELECT n FROM sizes) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY term), "
    "idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf), "
)
#: found: the hits' messages and their threads. refs: as a prompt numbers them.
_THREADS = "found AS (SELECT m.*, h.place AS hit_rank FROM messages m LEFT JOIN hits h ON h.id = m.message_id WHERE h.id IS NOT NULL OR (conversation_id <> '' AND conversation_id IN (SELECT conversation_id FROM messages JOIN {0} ON id = message_id))) "
_REFS = ", ranks AS (SELECT conversation_id, min(hit_rank) AS thread_rank FROM found WHERE conversation_id <> '' GROUP BY 1), refs AS (SELECT f.*, row_number() OVER (ORDER BY f.conversation_id = '', CASE WHEN f.conversation_id = '' THEN hit_rank ELSE thread_rank END, date, message_id) AS ref FROM found f LEFT JOIN ranks USING (conversation_id)) "
MEETING = ("the report of the team", ["assistant2", "user3 and the others", "", "nobody asks for this one"])
_MEETING_ASKS = [(MEETING[0], 10, True), (MEETING[1][0], 5, False), (MEETING[1][1], 5, False), (f"meeting summary notes {MEETING[0]}", 5, False)]


@query("meeting_prep", MAIL_WORDS + "".join(_search_sql(str(i), q, n, rerank=r) for i, (q, n, r) in enumerate(_MEETING_ASKS, 1)) + "every AS (" + " UNION ALL ".join(f"SELECT id, {i} AS query_no, place AS spot FROM hits_{i}" for i in range(1, 5)) + "), hits AS (SELECT id, query_no, row_number() OVER (ORDER BY query_no, spot, id) AS place FROM (SELECT id, min(query_no) AS query_no, arg_min(spot, (query_no, spot)) AS spot FROM every GROUP BY id)), " + _THREADS.format("hits") + _REFS + "SELECT message_id, ref, hit_rank, (SELECT query_no FROM hits WHERE id = message_id)::INTEGER AS query_no FROM refs")
def _(m, spark, sf):
    """What a meeting's brief is written from: four searches united, with threads, numbered."""
    found = assist.for_meeting(_box(m, spark, sf), *MEETING)
    return context.numbered(found.messages).join(found.hits.select(F.col("id").alias("message_id"), "query_no"), "message_id", "left").select("message_id", "ref", "hit_rank", "query_no")


TOPIC = "the plan and the model"


@query("research_found", MAIL_WORDS + _search_sql("r", TOPIC, 50, rerank=False, above=0.3) + "hits AS (SELECT * FROM hits_r), " + _THREADS.format("hits") + ", g AS (SELECT CASE WHEN conversation_id = '' THEN message_id ELSE conversation_id END AS id, min(date) AS first_date, max(date) AS last_date, count(*) AS message_count, string_agg(DISTINCT sender, ',' ORDER BY sender) AS participants, arg_max({'s': subject, 'd': direction, 'r': is_replied}, (date, message_id)) AS l FROM found GROUP BY 1) SELECT id, first_date, last_date, message_count, participants, l.s AS subject, CASE WHEN l.d <> 'sent' AND NOT l.r THEN 'needs_action' WHEN l.d = 'sent' THEN 'awaiting_response' ELSE 'completed' END AS status FROM g")
def _(m, spark, sf):
    return assist.research_timeline(assist.for_research(_box(m, spark, sf), TOPIC))


@query("topic_map_found", MAIL_WORDS + _search_sql("t", TOPIC, 50, rerank=False, above=0.25) + "hits AS (SELECT * FROM hits_t), " + _THREADS.format("hits") + ", named AS (SELECT *, lower(trim(sender)) AS person FROM found WHERE email_type <> 'meeting_note') SELECT DISTINCT 'person_' || person AS src, CASE WHEN conversation_id <> '' THEN 'thread_' || conversation_id ELSE 'email_' || message_id END AS dst, CASE WHEN conversation_id <> '' THEN 'participated' ELSE 'sent' END AS type FROM named")
def _(m, spark, sf):
    return assist.topic_map(_box(m, spark, sf), TOPIC)[1]


@query("entity_map_found", MAIL_WORDS + _search_sql("e", TOPIC, 30, above=0.45) + "hits AS (SELECT id, place FROM hits_e), tops AS (SELECT id FROM hits QUALIFY row_number() OVER (ORDER BY place) <= (SELECT count(*) // 2 + 1 FROM hits)), " + _THREADS.format("tops") + "SELECT lower(trim(sender)) AS person, count(*) AS n FROM found WHERE email_type <> 'meeting_note' GROUP BY 1")
def _(m, spark, sf):
    """People of an entity map of what a search found."""
    return graph.people(assist.entity_map(_box(m, spark, sf), TOPIC).messages).select("person", "n")


UNREAD = "unread: the plan and the model"


def _counting(prompt: str) -> str:
    n = prompt.count("--- Message [SRC-")
    return f"{n} messages, the last is [SRC-{n}]"


@query("question_answered", MAIL_WORDS + _search_sql("q", UNREAD, 30, "NOT is_read AND direction = 'received'") + "hits AS (SELECT * FROM hits_q), " + _THREADS.format("hits") + _REFS + "SELECT '1' AS ask_id, least(30, count(*)) || ' messages, the last is [SRC-' || least(30, count(*)) || ']' AS answer, 1 AS attempts, coalesce(string_agg(message_id, ',' ORDER BY ref) FILTER (ref <= 30), '') AS refs, 'unread' AS query_type, (SELECT count(*) FROM hits) AS emails_found, count(DISTINCT nullif(conversation_id, '')) AS threads_included FROM refs")
def _(m, spark, sf):
    """From a question to an answer; the model counts what it was given."""
    out = assist.answered(_box(m, spark, sf), UNREAD, filters.datetime.fromisoformat(NOW), lambda: _counting)
    return out.select("ask_id", "answer", "attempts", F.array_join("refs", ",").alias("refs"), "query_type", "emails_found", "threads_included")


# --- graphs -------------------------------------------------------------------------------------

PEOPLE = f"{MESSAGES[:-1]}, named AS (SELECT *, lower(trim(sender)) AS person FROM messages WHERE email_type <> 'meeting_note'), people AS (SELECT person, count(*) AS n, arg_min(CASE WHEN sender_name = '' THEN person ELSE sender_name END, (sender_name = '', date, message_id)) AS name FROM named GROUP BY person) "
ORGS = f"{PEOPLE[:-1]}, orgs AS (SELECT split_part(person, '@', 2) AS domain, count(*) AS members, sum(n)::BIGINT AS n FROM people GROUP BY 1 HAVING count(*) >= 2 AND split_part(person, '@', 2) NOT IN {graph.FREEMAIL}) "
ABOUT = "the que"
TOPICS = f"{PEOPLE[:-1]}, t AS (SELECT *, {STRIP.format(chr(39) + chr(39) + ' || regexp_replace(subject, ' + chr(39) + '^(?:RE:|Re:|FW:|Fwd:|re:|fw:)\\s*' + chr(39) + ', ' + chr(39) + chr(39) + ')')} AS topic FROM messages), topics AS (SELECT topic, count(*) AS n, count(DISTINCT nullif(conversation_id, '')) AS threads FROM t WHERE topic <> '' AND (contains(lower(topic), 'the') OR contains(lower(topic), 'que')) GROUP BY 1) "


@query("entity_people", f"{PEOPLE} SELECT * FROM people")
def _(m, *_a):
    return graph.people(m)


@query("best_display_name", f"{PEOPLE} SELECT person, name FROM people WHERE name <> person")
def _(m, *_a):
    return graph.people(m).where("name <> person").select("person", "name")


@query("entity_topics", f"{TOPICS} SELECT * FROM topics")
def _(m, *_a):
    return graph.topics(m, ABOUT)


@query("entity_orgs", f"{ORGS} SELECT domain, upper(substr(split_part(domain, '.', 1), 1, 1)) || substr(split_part(domain, '.', 1), 2) AS label, members, n FROM orgs")
def _(m, *_a):
    return graph.organizations(graph.people(m)).select("domain", "label", "members", "n")


CUTS = "v AS (SELECT list(n ORDER BY n) AS v FROM people), cuts AS (SELECT CASE WHEN len(v) >= 3 THEN v[floor(len(v) * 0.66)::INT + 1] ELSE v[len(v)] END AS high, CASE WHEN len(v) >= 3 THEN v[floor(len(v) * 0.33)::INT + 1] ELSE 1 END AS low FROM v) "
TIERED = f"{ORGS[:-1]}, {CUTS[:-1]}, tiered AS (SELECT person AS id, 'person' AS type, n, CASE WHEN n >= high THEN 'A' WHEN n >= low THEN 'B' ELSE 'C' END AS tier FROM people, cuts UNION ALL SELECT domain, 'organization', n, CASE WHEN n >= high THEN 'A' WHEN n >= low THEN 'B' ELSE 'C' END FROM orgs, cuts) "


def _tiered(m):
    p = graph.people(m)
    by = graph.cutoffs(p)
    persons = graph.tiers(p.select(F.col("person").alias("id"), F.lit("person").alias("type"), "n"), by)
    return persons.unionByName(graph.tiers(graph.organizations(p).select(F.col("domain").alias("id"), F.lit("organization").alias("type"), "n"), by))


@query("entity_tiers", f"{TIERED} SELECT * FROM tiered")
def _(m, *_a):
    return _tiered(m)


ORG_PART = ORGS.removeprefix(PEOPLE[:-1])
_TIER = "CASE WHEN n >= {0}high THEN 'A' WHEN n >= {0}low THEN 'B' ELSE 'C' END"
ENTITIES = f"{TOPICS[:-1]}{ORG_PART[:-1]}, {CUTS[:-1]}, {CUTS[:-1].replace('v AS (', 'tv AS (').replace('FROM people', 'FROM topics').replace('cuts AS', 'tcuts AS').replace('FROM v)', 'FROM tv)')}"


@query("entity_map_nodes", f"{ENTITIES} SELECT 'person_' || person AS id, 'person' AS type, name AS label, n, {_TIER.format('cuts.')} AS tier FROM people, cuts UNION ALL SELECT 'topic_' || topic, 'topic', substr(topic, 1, 50), n, {_TIER.format('tcuts.')} FROM topics, tcuts UNION ALL SELECT 'organization_' || domain, 'organization', upper(substr(domain, 1, 1)) || substr(split_part(domain, '.', 1), 2), n, {_TIER.format('cuts.')} FROM orgs, cuts")
def _(m, *_a):
    return graph.entity_nodes(m, ABOUT)


@query("entity_map_stats", f"{TOPICS[:-1]}{ORG_PART[:-1]}, p AS (SELECT DISTINCT conversation_id, person FROM named WHERE conversation_id <> ''), e AS (SELECT DISTINCT a.person, b.person AS other FROM p a JOIN p b ON a.conversation_id = b.conversation_id AND a.person < b.person UNION ALL SELECT DISTINCT lower(trim(sender)), topic FROM t WHERE topic IN (SELECT topic FROM topics) AND lower(trim(sender)) IN (SELECT person FROM people) UNION ALL SELECT person, domain FROM people JOIN orgs ON orgs.domain = split_part(person, '@', 2)) SELECT (SELECT count(*) FROM people) AS people, (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM orgs) AS organizations, (SELECT count(*) FROM e) AS connections, (SELECT count(*) FROM messages) AS total_emails")
def _(m, *_a):
    return graph.entity_stats(with_document(m), ABOUT)


@query("node_sizes", f"{TIERED}, lim AS (SELECT *, CASE tier WHEN 'A' THEN 30 WHEN 'B' THEN 20 ELSE 12 END AS lo, CASE tier WHEN 'A' THEN 45 WHEN 'B' THEN 30 ELSE 20 END AS hi, max(n) OVER (PARTITION BY type, tier) AS peak FROM tiered) SELECT id, tier, round(lo + (hi - lo) * n / peak, 4) AS size FROM lim")
def _(m, *_a):
    return graph.node_sizes(_tiered(m)).select("id", "tier", "size")


def _actions(body):
    parts = ", ".join(f"list_transform(regexp_extract_all({body}, '{p}', 1), lambda s, i: {{'k': {k}, 'i': i, 'item': substr({STRIP.format('s')}, 1, 120)}})" for k, p in enumerate(graph.ACTIONS))
    return f"list_concat({parts})"


PROSE = f"{MESSAGES[:-1]}, said AS (SELECT sender, date, message_id, body || ' Please send the quarterly report' || turn || '. TODO: call back' || chr(10) || 'We need to finish all of this' || (conv_id % 3) || '.' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'URGENT and overdue' ELSE 'we are waiting for you' END AS body FROM messages) "


def _said(m):
    tail = F.concat(F.lit(" Please send the quarterly report"), F.col("turn").cast("string"), F.lit(". TODO: call back\nWe need to finish all of this"), (F.col("conv_id") % 3).cast("string"), F.lit(".\n"), F.when(F.col("turn") % 3 == 0, "URGENT and overdue").otherwise("we are waiting for you"))
    return m.withColumn("body", F.concat("body", tail))


@query("entity_action_items", f"{PROSE}, e AS (SELECT lower(trim(sender)) AS person, date, message_id, unnest({_actions('body')}) AS f FROM said), one AS (SELECT person, f.item AS item, min((date, message_id, f.k, f.i)) AS place_key FROM e WHERE f.item <> '' GROUP BY 1, 2), r AS (SELECT person, item, row_number() OVER (PARTITION BY person ORDER BY place_key) AS place FROM one) SELECT * FROM r WHERE place <= 5")
def _(m, *_a):
    return graph.action_items(_said(m))


@query("entity_sentiments", f"{PROSE}, e AS (SELECT DISTINCT lower(trim(sender)) AS person, unnest(list_filter([" + ", ".join(f"CASE WHEN contains(lower(body), '{w}') THEN '{t}' END" for w, t in graph.MOODS.items()) + "], lambda x: x IS NOT NULL)) AS tag FROM said) SELECT person, string_agg(tag, ',' ORDER BY tag) AS tags FROM e GROUP BY 1")
def _(m, *_a):
    return graph.moods(_said(m))


PHRASES = f"items AS (SELECT regexp_extract_all(lower(text), '{T.TOKEN}') AS ts FROM benchmark), phrases AS (SELECT phrase, 't' || (length(phrase) % 10) AS tag FROM (SELECT unnest(ts) AS phrase FROM items UNION SELECT ts[i] || ' ' || ts[i + 1] FROM items, unnest(range(1, len(ts))) u(i)) WHERE length(phrase) >= 6) "


def _phrases(spark, sf):
    """Some thousand phrases: the longer words and all pairs of words of the benchmark's items, tagged by their length."""
    words = table(spark, sf, "benchmark").select(T.tokenize(F.col("text")).alias("ts"))
    pairs = F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts")), lambda a, b: F.concat_ws(" ", a, b))
    every = words.where(F.size("ts") > 0).select(F.explode(F.concat("ts", pairs)).alias("phrase")).where(F.length("phrase") >= 6).distinct()
    return every.select("phrase", F.concat(F.lit("t"), (F.length("phrase") % 10).cast("string")).alias("tag"))


@query("entity_phrase_tags", f"{MESSAGES[:-1]}, {PHRASES} SELECT lower(trim(sender)) AS person, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM messages JOIN phrases ON contains(lower(body), phrase) GROUP BY 1")
def _(m, spark, sf):
    return graph.moods(m, _phrases(spark, sf))


@query("phrase_subjects", f"{MESSAGES[:-1]}, {PHRASES} SELECT DISTINCT message_id, tag FROM messages JOIN phrases ON contains(lower(subject), phrase)")
def _(m, spark, sf):
    """Which messages have a subject that a table of phrases is about."""
    return phrases.tagged(m, _phrases(spark, sf), "message_id", "subject")


COUNTS = f"tc AS (SELECT conversation_id, count(*) FILTER (is_replied) AS replies, count(*) FILTER (contains(substr({DOC}, 1, 200), '>')) AS quotes FROM messages WHERE conversation_id <> '' GROUP BY 1) "


@query("thread_reply_quote_counts", f"{MESSAGES[:-1]}, {COUNTS} SELECT * FROM tc")
def _(m, *_a):
    return graph.thread_counts(with_document(m))


_PAIRS = f"{PEOPLE[:-1]}, {COUNTS[:-1]}, p AS (SELECT DISTINCT conversation_id, person FROM named WHERE conversation_id <> ''), pt AS (SELECT a.person AS src, b.person AS dst, a.conversation_id FROM p a JOIN p b ON a.conversation_id = b.conversation_id AND a.person < b.person) "
PAIR_EDGES = f"{_PAIRS} SELECT src, dst, count(*) AS weight, sum(replies)::BIGINT AS replies, sum(quotes)::BIGINT AS quotes FROM pt JOIN tc USING (conversation_id) GROUP BY 1, 2"


@query("edges_person_person", PAIR_EDGES.replace(f"substr({DOC}, 1, 200)", DOC).replace(" AS quotes FROM pt", " AS quotes, string_agg(conversation_id, ',' ORDER BY conversation_id) AS thread_ids FROM pt"))
def _(m, *_a):
    return graph.person_pairs(with_document(m), with_threads=True).withColumn("thread_ids", F.array_join("thread_ids", ","))


@query("edges_person_person_threads", f"{_PAIRS} SELECT * FROM pt")
def _(m, *_a):
    return graph.pair_threads(m)


@query("edges_incremental", PAIR_EDGES)
def _(m, spark, sf):
    """Edges after three batches, of which the later ones touch threads of the earlier ones."""
    view, rows = graph.EdgeView(spark, _place(spark, "edges")), with_document(m)
    for batch, where in (("a", "turn < 2"), ("b", "turn between 2 and 4 and conv_id % 3 = 0"), ("b", "turn < 2"), ("c", "turn > 4 or (turn > 1 and conv_id % 3 <> 0)")):
        view.add(rows.where(where), batch)  # the second "b" is a repeated run
    return view.edges


_TOPIC_ROWS = f"{TOPICS[:-1]}, tt AS (SELECT lower(trim(sender)) AS person, t.topic, nullif(conversation_id, '') AS thread FROM t JOIN topics USING (topic) WHERE lower(trim(sender)) IN (SELECT person FROM people)) "


@query("edges_person_topic", f"{_TOPIC_ROWS} SELECT person, topic, count(*) AS weight, count(DISTINCT thread) AS threads, coalesce(string_agg(DISTINCT thread, ',' ORDER BY thread), '') AS thread_ids FROM tt GROUP BY 1, 2")
def _(m, *_a):
    return graph.person_topics(m, graph.people(m), graph.topics(m, ABOUT), with_threads=True).withColumn("thread_ids", F.array_join("thread_ids", ","))


@query("edges_person_topic_threads", f"{_TOPIC_ROWS} SELECT person, topic, thread, count(*) AS n FROM tt WHERE thread IS NOT NULL GROUP BY ALL")
def _(m, *_a):
    return graph.topic_threads(m, graph.people(m), graph.topics(m, ABOUT))


@query("edges_person_org", f"{ORGS} SELECT person, domain, 1 AS weight FROM people JOIN orgs ON orgs.domain = split_part(person, '@', 2)")
def _(m, *_a):
    p = graph.people(m)
    return graph.person_orgs(p, graph.organizations(p))


NODES = f"{PEOPLE[:-1]}, nodes AS (SELECT 'thread_' || conversation_id AS id, 'thread' AS type, substr(arg_max(subject, (date, message_id)), 1, 40) AS label, count(*) AS n FROM messages WHERE conversation_id <> '' GROUP BY conversation_id UNION ALL SELECT 'person_' || person, 'person', name, n FROM people UNION ALL SELECT 'email_' || message_id, 'email', substr(subject, 1, 40), 1 FROM messages WHERE conversation_id = ''), edges AS (SELECT DISTINCT 'person_' || person AS src, CASE WHEN conversation_id <> '' THEN 'thread_' || conversation_id ELSE 'email_' || message_id END AS dst, CASE WHEN conversation_id <> '' THEN 'participated' ELSE 'sent' END AS type FROM named) "


@query("topic_map_nodes", f"{NODES} SELECT * FROM nodes")
def _(m, *_a):
    return graph.topic_map_nodes(m)


@query("topic_map_edges", f"{NODES} SELECT * FROM edges")
def _(m, *_a):
    return graph.topic_map_edges(m)


@query("graph_stats", f"{NODES} SELECT (SELECT count(*) FROM nodes WHERE type = 'thread') AS threads, (SELECT count(*) FROM nodes WHERE type = 'person') AS people, (SELECT count(*) FROM nodes WHERE type = 'email') AS emails, (SELECT count(*) FROM edges) AS edges")
def _(m, *_a):
    kind = lambda t: F.count_if(F.col("type") == t)
    return graph.topic_map_nodes(m).agg(kind("thread").alias("threads"), kind("person").alias("people"), kind("email").alias("emails")).join(graph.topic_map_edges(m).agg(F.count("*").alias("edges")))


@query("graph_view_filter", f"{NODES}, shown AS (SELECT id FROM nodes WHERE n >= 3) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)")
def _(m, *_a):
    return graph.visible(graph.topic_map_nodes(m), graph.topic_map_edges(m), F.col("n") >= 3)[1].select("src", "dst", "type")


@query("pair_edges_at_scale", "SELECT a.l_partkey % 500 AS src, b.l_partkey % 500 AS dst, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey % 500 < b.l_partkey % 500 GROUP BY 1, 2")
def _(m, spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 500).alias("p"))
    return p.alias("a").join(p.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.p < b.p")).groupBy(F.col("a.p").alias("src"), F.col("b.p").alias("dst")).agg(F.count("*").alias("weight"))


# --- facts --------------------------------------------------------------------------------------

CARDS = f"{MESSAGES[:-1]}, cards AS (SELECT message_id AS email_id, sender, 'Acme ' || (conv_id % 5) AS e1, CASE turn % 3 WHEN 0 THEN 'request' WHEN 1 THEN 'question' ELSE 'update' END AS intent, sender AS who, 'send report ' || turn AS what FROM messages WHERE turn <> 3) "


def _cards(m):
    card = F.struct(F.array(F.concat(F.lit("Acme "), (F.col("conv_id") % 5).cast("string")), F.col("sender")).alias("entities"), F.array(F.element_at(F.array(F.lit("request"), F.lit("question"), F.lit("update")), (F.col("turn") % 3 + 1).cast("int"))).alias("intents"), F.array(F.struct(F.col("sender").alias("who"), F.concat(F.lit("send report "), F.col("turn").cast("string")).alias("what"), F.lit("Friday").alias("by_when"))).alias("commitments"), F.when(F.col("turn") == 2, F.array(F.struct(F.lit("call back").alias("description"), F.col("recipient1").alias("assignee"), F.lit("").alias("deadline")))).otherwise(F.array().cast("array<struct<description:string,assignee:string,deadline:string>>")).alias("action_items"), F.lit("neutral").alias("sentiment"))
    answer = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("```json\n")).otherwise(F.lit(" ")), F.when(F.col("turn") == 3, F.lit("no json here")).otherwise(F.to_json(card)), F.when(F.col("turn") % 2 == 0, F.lit("\n```")).otherwise(F.lit("")))
    return m.select(F.col("message_id").alias("email_id"), facts.parse_card(answer).alias("card")).where("card is not null")


@query("fact_cards_parse", f"{CARDS} SELECT email_id, e1 || ',' || sender AS entities, intent AS intents FROM cards")
def _(m, *_a):
    return _cards(m).select("email_id", F.array_join("card.entities", ",").alias("entities"), F.array_join("card.intents", ",").alias("intents"))


@query("fact_card_explode", f"{CARDS} SELECT email_id, unnest([e1, sender]) AS entity FROM cards")
def _(m, *_a):
    return facts.entities(_cards(m))


@query("fact_card_lookup", f"{CARDS} SELECT email_id, intent AS intents FROM cards WHERE email_id = 'm1-1'")
def _(m, *_a):
    return _cards(m).where("email_id = 'm1-1'").select("email_id", F.array_join("card.intents", ",").alias("intents"))


@query("fact_card_save", f"{CARDS} SELECT email_id, CASE WHEN intent = 'question' THEN 'replaced' ELSE 'neutral' END AS sentiment FROM cards")
def _(m, *_a):
    c = _cards(m)
    news = c.where(F.array_contains("card.intents", "question")).withColumn("card", F.col("card").withField("sentiment", F.lit("replaced")))
    return facts.save(c, news).select("email_id", "card.sentiment")


@query("fact_commitments", f"{CARDS} SELECT email_id, who, what, 'Friday' AS by_when FROM cards WHERE who ILIKE '%ASSISTANT2%'")
def _(m, spark, sf):
    c = _cards(m)
    index = _once(spark, sf, "people", lambda path: TrigramIndex.build(facts.people(c), path, "email_id", "who"), "conversations")
    return facts.commitments(c, "ASSISTANT2", index)


@query("fact_action_items", f"{MESSAGES} SELECT message_id AS email_id, 'call back' AS description, recipient1 AS assignee, '' AS deadline FROM messages WHERE turn = 2 AND recipient1 ILIKE '%R3%'")
def _(m, *_a):
    return facts.action_items(_cards(m), "R3")


@query("fact_entity_search", f"{CARDS} SELECT email_id FROM cards WHERE e1 ILIKE '%acme 3%' OR sender ILIKE '%acme 3%'")
def _(m, spark, sf):
    c = _cards(m)
    index = _once(spark, sf, "entities", lambda path: TrigramIndex.build(facts.entities(c), path, "email_id", "entity"), "conversations")
    return facts.with_entity(c, "acme 3", index).select("email_id")


@query("fact_intent_search", f"{CARDS} SELECT email_id FROM cards WHERE intent = 'question'")
def _(m, *_a):
    return facts.with_intent(_cards(m), "question").select("email_id")


@query("fact_stats", f"{CARDS} SELECT count(*) AS cards, (SELECT count(DISTINCT e) FROM (SELECT unnest([e1, sender]) AS e FROM cards)) AS entities, count(*) AS commitments, (SELECT count(*) FROM messages WHERE turn = 2) AS action_items FROM cards")
def _(m, *_a):
    return facts.stats(_cards(m))


@query("fact_context", f"{CARDS}, l AS (SELECT * FROM cards ORDER BY email_id LIMIT 15) SELECT string_agg('- ' || who || ': ' || what, chr(10) ORDER BY '- ' || who || ': ' || what) AS text FROM l")
def _(m, *_a):
    return facts.context(_cards(m), "what did we commit to?")


def _reader(prompt: str) -> str:
    """A stand-in for a model: a card for each message of a call, with its first word and length; no JSON where a call of several holds the word 'quality'."""
    parts = re.split(r"(?m)^--- Message \d+ ---\n", prompt)[1:] if prompt.startswith("--- Message 0 ---") else None
    card = lambda t: {"entities": t.split()[:1], "key_facts": [str(len(t.rstrip("\n")))], "sentiment": "neutral" if parts else "alone"}
    if parts is None:
        return json.dumps(card(prompt))
    if "quality" in prompt:
        return "I'm sorry, no cards."
    return "```json\n" + json.dumps([card(t) | {"email_index": i} for i, t in enumerate(parts)] + [{"email_index": 99}]) + "\n```"


@query("fact_extraction", f"{MESSAGES} SELECT message_id AS email_id, string_split_regex(trim(regexp_replace(body, '^\\s+', '')), '\\s+')[1] AS first_word, length(regexp_replace(body, '\\n+$', ''))::VARCHAR AS size FROM messages")
def _(m, *_a):
    """One call for five messages; which calls fall back to single ones depends on how they are dealt, the cards don't."""
    answers = facts.extract(m.select("message_id", F.col("body").alias("text")), _reader)
    return answers.select("email_id", facts.parse_card(F.col("answer")).alias("card")).select("email_id", F.get("card.entities", 0).alias("first_word"), F.get("card.key_facts", 0).alias("size"))


# --- prompts ------------------------------------------------------------------------------------

REFS = f"{MESSAGES[:-1]}, h AS (SELECT *, row_number() OVER (ORDER BY date DESC, message_id) AS hit_rank FROM messages ORDER BY date DESC, message_id LIMIT 30), tr AS (SELECT conversation_id, min(hit_rank) AS thread_rank FROM h WHERE conversation_id <> '' GROUP BY 1), refs AS (SELECT h.*, row_number() OVER (ORDER BY h.conversation_id = '', CASE WHEN h.conversation_id = '' THEN hit_rank ELSE thread_rank END, date, message_id) AS ref FROM h LEFT JOIN tr ON tr.conversation_id = h.conversation_id) "
RENDER = "'Direction: ' || CASE WHEN direction = 'sent' THEN 'SENT BY ME' ELSE 'RECEIVED' END || chr(10) || 'From: ' || coalesce(nullif(sender_name, ''), sender) || chr(10) || 'Subject: ' || subject || chr(10) || 'Date: ' || strftime(date, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Status: ' || CASE WHEN is_read THEN 'Read' ELSE 'UNREAD' END || ' | Replied: ' || CASE WHEN is_replied THEN 'Yes' ELSE 'NO - NOT REPLIED' END || chr(10) || chr(10) || 'CONTENT:' || chr(10) || substr({0}, 1, {1}) || CASE WHEN length({0}) > {1} THEN chr(10) || '[...truncated...]' ELSE '' END"


def _numbered(m):
    """The 30 latest messages, as a chat's prompt holds that many hits, with their numbers."""
    h = m.orderBy(F.desc("date"), "message_id").limit(30)
    return context.numbered(search.ranked(h, "date", "message_id").select(F.col("id").alias("message_id"), F.col("rank").alias("hit_rank")).join(h, "message_id"))


@query("src_numbering", f"{REFS} SELECT message_id, ref FROM refs")
def _(m, *_a):
    return _numbered(m).select("message_id", "ref")


@query("message_render", f"{MESSAGES} SELECT message_id, {RENDER.format(STRIP.format('body'), 300)} AS text FROM messages")
def _(m, *_a):
    return m.select("message_id", context.render(300).alias("text"))


@query("context_render", f"{REFS} SELECT string_agg('--- Message [SRC-' || ref || ']' || chr(10) || {RENDER.format(STRIP.format('body'), 1000)}, chr(10) || chr(10) ORDER BY ref) AS context, count(*) AS n FROM refs")
def _(m, *_a):
    return context.assembled(_numbered(m), 1000)


@query("context_budget", f"{REFS.replace('LIMIT 30', 'LIMIT 15')} SELECT string_agg('--- Message [SRC-' || ref || ']' || chr(10) || {RENDER.format(STRIP.format('body'), 1000)}, chr(10) || chr(10) ORDER BY ref) AS context, count(*) AS n FROM refs")
def _(m, *_a):
    """What a local model's budget takes of the 30 hits."""
    h = m.orderBy(F.desc("date"), "message_id").limit(30)
    hits = search.ranked(h, "date", "message_id").select(F.col("id").alias("message_id"), F.col("rank").alias("hit_rank")).join(h, "message_id")
    kept, chars = context.within(hits, Config().budget(local=True))
    return context.assembled(context.numbered(kept), chars)


@query("context_shrink", f"{REFS}, o AS (SELECT message_id, row_number() OVER (ORDER BY date, message_id) AS age, count(*) OVER () AS n FROM refs) SELECT message_id FROM o WHERE age > greatest(n // 3, 1)")
def _(m, *_a):
    return context.shrunk(_numbered(m)).select("message_id")


@query("citation_resolve", f"{REFS}, a AS (SELECT conv_id AS answer_id, 'x [SRC-' || (conv_id % 12) || '] y [SRC-' || (conv_id % 12) || '] z [SRC-99999]' AS answer FROM messages WHERE turn = 0), f AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(answer, '\\[(SRC-\\d+)\\]', 1)) AS ref_key FROM a) SELECT answer_id, ref_key, message_id FROM f LEFT JOIN refs ON 'SRC-' || ref = ref_key")
def _(m, *_a):
    n = (F.col("conv_id") % 12).cast("string")
    answers = m.where("turn = 0").select(F.col("conv_id").alias("answer_id"), F.concat(F.lit("x [SRC-"), n, F.lit("] y [SRC-"), n, F.lit("] z [SRC-99999]")).alias("answer"))
    return context.cited(answers, context.reference_map(_numbered(m)))


@query("event_stream", f"{MESSAGES[:-1]}, e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, message_id) AS event_no, 'data: ' || json_object('conv_id', conv_id, 'turn', turn, 'message_id', message_id)::VARCHAR || chr(10) || chr(10) AS event FROM messages) SELECT * FROM e UNION ALL SELECT conv_id, max(event_no) + 1, 'data: [DONE]' || chr(10) || chr(10) FROM e GROUP BY 1")
def _(m, *_a):
    return context.as_events(m.select("conv_id", "turn", "message_id"), "conv_id", ("turn", "message_id"))


@query("event_stream_of_all", f"""{MESSAGES[:-1]}, n AS (SELECT row_number() OVER (ORDER BY turn, conv_id) AS event_no, conv_id, turn FROM messages) SELECT event_no, 'data: {{"conv_id":' || conv_id || ',"turn":' || turn || '}}' || chr(10) || chr(10) AS event FROM n UNION ALL SELECT max(event_no) + 1, 'data: [DONE]' || chr(10) || chr(10) FROM n HAVING count(*) > 0""")
def _(m, *_a):
    return context.as_events(m.select("conv_id", "turn"), None, ("turn",))


PROMPTS = f"{MESSAGES[:-1]}, k AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'meeting' ELSE 'research' END AS kind, CASE WHEN conv_id % 4 = 0 THEN '' ELSE body END AS context FROM messages) "
_case = lambda texts: "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


@query("prompt_kinds", f"{PROMPTS} SELECT message_id, {_case(context.INSTRUCTIONS)} || chr(10) || chr(10) || 'NOW ' || strftime(date, '%A, %B %d, %Y %H:%M') || chr(10) || chr(10) || CASE WHEN kind = 'meeting' THEN 'TIME ' || strftime(date, '%Y-%m-%d %H:%M') || ' to ' || strftime(date + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') || chr(10) || 'PEOPLE ' || recipient1 || ', ' || recipient2 || chr(10) || 'PLACE not given' || chr(10) || chr(10) ELSE '' END || CASE WHEN context <> '' THEN 'MESSAGES' || chr(10) || context ELSE {_case(context.NOTHING)} END || chr(10) || chr(10) || CASE kind WHEN 'chat' THEN 'QUESTION' WHEN 'meeting' THEN 'MEETING' ELSE 'TOPIC' END || chr(10) || subject AS prompt FROM k")
def _(m, *_a):
    kind = F.element_at(F.array(F.lit("chat"), F.lit("meeting"), F.lit("research")), (F.col("turn") % 3 + 1).cast("int"))
    details = F.when(kind == "meeting", context.meeting_details(F.col("date"), F.col("date") + F.expr("INTERVAL 30 MINUTES"), F.array("recipient1", "recipient2"), F.lit("")))
    return m.select("message_id", context.prompt_of(kind, F.col("subject"), F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("body")), F.col("date"), details).alias("prompt"))


_left = lambda n: f"({n} - greatest(1, {n} // 3))"


def _narrow(prompt: str) -> str:
    """A model that takes two messages; it answers with their number."""
    n = prompt.count("--- Message [SRC-")
    if n > 2:
        raise context.Overflow(f"{n} messages")
    return f"{n} messages, last [SRC-{n}]"


ANSWERED = f"{MESSAGES[:-1]}, c AS (SELECT conv_id, count(*) AS n0 FROM messages GROUP BY 1), a AS (SELECT *, {_left('n0')} AS n1 FROM c), b AS (SELECT *, {_left('n1')} AS n2 FROM a), d AS (SELECT *, {_left('n2')} AS n3 FROM b), f AS (SELECT conv_id, CASE WHEN n0 <= 2 THEN n0 WHEN n1 <= 2 THEN n1 WHEN n2 <= 2 THEN n2 WHEN n3 <= 2 THEN n3 END AS n, CASE WHEN n0 <= 2 THEN 1 WHEN n1 <= 2 THEN 2 WHEN n2 <= 2 THEN 3 ELSE 4 END AS attempts FROM d), refs AS (SELECT conv_id, message_id, row_number() OVER (PARTITION BY conv_id ORDER BY date DESC, message_id DESC) AS age, date FROM messages), ans AS (SELECT conv_id::VARCHAR AS ask_id, coalesce(n || ' messages, last [SRC-' || n || ']', '') AS answer, attempts, coalesce((SELECT string_agg(message_id, ',' ORDER BY date, message_id) FROM refs WHERE refs.conv_id = f.conv_id AND age <= n), '') AS refs FROM f) "


def _answered(m):
    asks = m.groupBy(F.col("conv_id").alias("ask_id")).agg(F.sort_array(F.collect_list(F.struct("date", "message_id", F.col("body").alias("text")))).alias("messages"))
    return context.ask(asks.withColumn("question", F.lit("what is open?")), lambda: _narrow)


@query("answer_retry", f"{ANSWERED} SELECT * FROM ans")
def _(m, *_a):
    return _answered(m).select("ask_id", "answer", "attempts", F.array_join("refs", ",").alias("refs"))


@query("answer_stream", f"{ANSWERED}, o AS (SELECT ask_id, i AS place, substr(answer, i * 8 + 1, 8) AS content, 'chunk' AS type FROM ans, unnest(range(0, greatest(1, (length(answer) + 7) // 8))) u(i)) SELECT ask_id, count(*) + 1 + (SELECT count(*) FROM ans x WHERE x.ask_id = o.ask_id AND refs <> '') AS events, string_agg(content, '' ORDER BY place) AS said FROM o GROUP BY 1")
def _(m, *_a):
    """The events of each answer, counted, and their pieces joined again."""
    e = context.answer_events(_answered(m), 8)
    body = F.from_json(F.substring_index(F.substr("event", F.lit(7)), "\n\n", 1), "type string, content string")
    piece = F.when(body["type"] == "chunk", F.struct("event_no", body["content"].alias("content")))
    return e.groupBy("ask_id").agg(F.count("*").alias("events"), F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["content"]), "").alias("said"))


@query("prompt_build", f"{MESSAGES} SELECT message_id, 'Answer from the messages only.' || chr(10) || chr(10) || 'MESSAGES' || chr(10) || body || chr(10) || chr(10) || 'QUESTION' || chr(10) || 'what is open?' AS prompt FROM messages")
def _(m, *_a):
    return m.select("message_id", context.prompt("what is open?", F.col("body"), "Answer from the messages only.").alias("prompt"))


# --- the rest of the surface ----------------------------------------------------------------------


@query("edge_widths", f"{PEOPLE[:-1]}, p AS (SELECT DISTINCT conversation_id, person FROM named WHERE conversation_id <> ''), e AS (SELECT a.person || '|' || b.person AS pair, count(*) AS weight FROM p a JOIN p b ON a.conversation_id = b.conversation_id AND a.person < b.person GROUP BY 1) SELECT pair, weight, least(8.0, 1 + weight * 0.5)::DOUBLE AS width FROM e")
def _(m, *_a):
    return graph.edge_widths(graph.person_pairs(with_document(m)))


@query("mail_open_cascade", f"{MESSAGES[:-1]}, a AS (SELECT conv_id AS ask_id, CASE WHEN conv_id % 3 = 0 THEN message_id END AS id, CASE WHEN conv_id % 3 = 1 THEN 'h' || message_id END AS header_id, CASE WHEN conv_id % 3 = 2 THEN lower(substr(subject, 1, 12)) END AS words FROM messages WHERE turn = 0) SELECT ask_id, coalesce(x.message_id, y.message_id, (SELECT min(z.message_id) FROM messages z WHERE contains(lower(z.subject), a.words))) AS message_id FROM a LEFT JOIN messages x ON x.message_id = a.id LEFT JOIN messages y ON 'h' || y.message_id = a.header_id")
def _(m, spark, sf):
    from postloom.operators.store import open_cascade

    subjects = _once(spark, sf, "subjects", lambda path: TrigramIndex.build(m, path, "message_id", "subject"), "conversations")
    k = F.col("conv_id") % 3
    asked = m.where("turn = 0").select(F.col("conv_id").alias("ask_id"), F.when(k == 0, F.col("message_id")).alias("id"), F.when(k == 1, F.concat(F.lit("h"), "message_id")).alias("header_id"), F.when(k == 2, F.substring("subject", 1, 12)).alias("words"))
    return open_cascade(asked, m.withColumn("header_id", F.concat(F.lit("h"), "message_id")), subjects)


@query("subject_search", f"{MESSAGES[:-1]}, w AS (SELECT DISTINCT lower(word) AS words FROM (SELECT unnest(string_split(substr(subject, 1, 40), ' ')) AS word FROM messages) WHERE word <> '') SELECT words, count(*) AS n, min(message_id) AS first FROM w JOIN messages ON contains(lower(subject), words) WHERE conv_id % 13 <> 0 GROUP BY 1")
def _(m, spark, sf):
    """Each word of a subject as a piece of any subject, in an index of two segments with removed messages."""

    def make(path):
        later = F.col("conv_id") % 2 == 0
        return TrigramIndex.build(m.where(~later), path, "message_id", "subject").add(m.where(later), "message_id", "subject").remove(m.where("conv_id % 13 = 0"), "message_id")

    words = m.select(F.explode(F.split(F.substring("subject", 1, 40), " ")).alias("words"))
    return _once(spark, sf, "subject_segments", make, "conversations").counts(words).select("words", "n", F.col("least").alias("first"))


@query("embed_hashed", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '" + T.TOKEN + "')) AS token FROM documents), p AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 2))::INTEGER % 64 AS place, count(*) AS n FROM t GROUP BY 1, 2) SELECT d.doc_id, count(n) AS places, arg_max(place, (n, -place)) AS top, coalesce(round(sum(n * (place + 1)) / sqrt(sum(n * n)), 4), 0) AS moment FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY 1")
def _(m, spark, sf):
    """What tells the values of each embedding: how many places it has, the largest, and the sum of values times places."""
    from postloom.operators.embed import hashed

    each = hashed(table(spark, sf, "documents")).select("doc_id", F.posexplode("embedding").alias("place", "value"))
    some = F.when(F.col("value") > 0, F.struct("value", -F.col("place")))
    return each.groupBy("doc_id").agg(F.count(some).alias("places"), F.max_by("place", some).alias("top"), F.round(F.sum(F.col("value") * (F.col("place") + 1)), 4).alias("moment"))


@query("embed_model", None)
def _(m, spark, sf):
    from postloom.operators.embed import embed

    return embed(m.select("message_id", F.col("body").alias("text")), lambda: lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]).select("message_id", F.get("embedding", 0).alias("length"))


@query("run_extraction", f"{MESSAGES} SELECT message_id AS email_id, CASE WHEN turn <> 3 THEN 'neutral' ELSE 'of ' || length(body) END AS sentiment FROM messages WHERE turn <> 3 OR length(body) % 2 = 0")
def _(m, *_a):
    """Messages without a card (those of turn 3) get one from a model that knows those of even length."""
    def model(p: str) -> str:
        parts = re.split(r"--- Message \d+ ---\n", p)[1:]
        return json.dumps([{"email_index": i, "sentiment": f"of {len(t)}"} for i, t in enumerate(x[:-1] if k < len(parts) - 1 else x for k, x in enumerate(parts)) if len(t) % 2 == 0])

    return facts.run_extraction(m.select("message_id", F.col("body").alias("text")), _cards(m), model).select("email_id", "card.sentiment")


@query("answers", None)
def _(m, *_a):
    return context.answers(m.select(F.col("message_id").alias("ask_id"), context.prompt("what is open?", F.col("body"), "Answer.").alias("prompt")), lambda: lambda p: f"{len(p)} characters read [SRC-1]")


@query("post_ingest", f"{MESSAGES} SELECT count(*) AS total, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction <> 'sent') AS received, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_flagged) AS flagged FROM messages WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 10 DAYS")
def _(m, spark, sf):
    from postloom.operators.store import Store, after_ingest

    store = Store(spark, _place(spark, "store"))
    store.days("messages", m)
    store.days("chunks", chunks.chunk(with_document(m).select(F.col("message_id").alias("email_id"), "subject", "document")), "email_id", None)
    return after_ingest(store, NOW, 10)
