"""Literal cases, one for each branch of the rules."""

from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postloom.config import Config, from_settings, identity
from postloom.functions import filters, message
from postloom.functions import text as T
from postloom.operators import analytics, chunks, context, graph, ingest, keyword, search, threads
from postloom.operators import backends, facts, retrieval, store
from postloom.operators.ann import VectorIndex
from postloom.operators.substrings import TrigramIndex
from postloom.sources import accounts, adapters, items, rfc822

NOW = "2024-01-25 00:00:00"
FRESH, OLD = "2024-01-24 00:00:00", "2024-01-10 23:59:59"
EDGE = "2024-01-11 00:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def L(s):
    return F.lit(s)


@pytest.mark.parametrize("mine, date, replied, thread, alone", [(True, FRESH, False, "awaiting_response", "awaiting_response"), (True, OLD, False, "stale", "awaiting_response"), (False, FRESH, True, "completed", "completed"), (False, FRESH, False, "needs_action", "needs_action"), (False, OLD, True, "stale_needs_action", "completed"), (False, OLD, False, "stale_needs_action", "stale_needs_action"), (False, EDGE, False, "needs_action", "needs_action"), (False, None, False, "needs_action", "needs_action")])
def test_states(spark, mine, date, replied, thread, alone):
    row = spark.range(1).select(L(mine).alias("mine"), L(date).cast("timestamp_ntz").alias("date"), L(replied).alias("is_replied"))
    got = row.select(threads.thread_state(NOW).alias("a"), threads.standalone_state(NOW).alias("b")).first()
    assert tuple(got) == (thread, alone)


@pytest.mark.parametrize("direction, replied, read, research, prompt, flags", [("received", False, False, "needs_action", "NEEDS ACTION", (False, True)), ("received", False, True, "needs_action", "NEEDS ACTION", (False, False)), ("received", True, True, "completed", "COMPLETED", (False, False)), ("sent", True, True, "awaiting_response", "COMPLETED", (False, False)), ("sent", False, True, "awaiting_response", "AWAITING RESPONSE", (True, False))])
def test_other_rules_of_state(spark, direction, replied, read, research, prompt, flags):
    row = spark.range(1).select(L(direction).alias("direction"), L(replied).alias("is_replied"), L(read).alias("is_read"))
    a, b = threads.model_flags()
    assert tuple(row.select(threads.research_state(), threads.prompt_state(), a, b).first()) == (research, prompt, *flags)


WED = datetime(2024, 1, 24, 15, 30)


@pytest.mark.parametrize("question, want", [("mail of today", (datetime(2024, 1, 24), datetime(2024, 1, 25))), ("Yesterday?", (datetime(2024, 1, 23), datetime(2024, 1, 24))), ("this week", (datetime(2024, 1, 22), WED)), ("last week", (datetime(2024, 1, 15), datetime(2024, 1, 22))), ("past 3 days", (datetime(2024, 1, 21, 15, 30), WED)), ("last 1 day", (datetime(2024, 1, 23, 15, 30), WED)), ("today or last week", (datetime(2024, 1, 24), datetime(2024, 1, 25))), ("whenever", None)])
def test_time_ranges(question, want):
    assert filters.time_range(question, WED) == want


@pytest.mark.parametrize("day", [22, 28])
def test_weeks_begin_on_monday(day):
    assert filters.time_range("this week", datetime(2024, 1, day, 9))[0] == datetime(2024, 1, 22)


@pytest.mark.parametrize("question, want", [("transaction list", "action_needed"), ("waiting for reply", "action_needed"), ("no response yet", "sent_followup"), ("UNREAD mail", "unread"), ("plain", "general")])
def test_question_types(spark, question, want):
    assert one(spark, filters.question_type(L(question))) == want


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, n int")
    names = lambda w: [r["n"] for r in df.where(filters.compile_filter(w)).orderBy("n").collect()]
    assert names({"s": "a"}) == [1] and names(None) == [1, 2, 3]
    assert names({"s": {"$gte": "b"}}) == [2] and names({"s": {"$lte": "a"}}) == [1, 3]
    assert names({"n": 9, "$and": [{"n": {"$gte": 2}}, {"s": {"$eq": "b"}}]}) == [2]
    with pytest.raises(ValueError):
        filters.compile_filter({"n": {"$ne": 1}})


@pytest.mark.parametrize("text, body, signature, disclaimer", [("hi\n-- \nBob", "hi", "-- \nBob", ""), ("hi\n___\nx", "hi", "___\nx", ""), ("hi\n---------- Forwarded message ---------\nx", "hi", "---------- Forwarded message ---------\nx", ""), ("hi\nSent from my iPhone", "hi", "Sent from my iPhone", ""), ("hi\n--\nBob\nThis email may contain\nx", "hi", "--\nBob", "This email may contain\nx"), ("a\nto unsubscribe click\nb", "a", "", "to unsubscribe click\nb"), ("", "", "", "")])
def test_boilerplate(spark, text, body, signature, disclaimer):
    assert tuple(one(spark, T.strip_boilerplate(L(text)))) == (body, signature, disclaimer)


@pytest.mark.parametrize("text, fresh, quoted", [("new\n\nOn Mon, Jan 1, 2024 at 10:00 Bob Smith wrote:\n> old", "new", "On Mon, Jan 1, 2024 at 10:00 Bob Smith wrote:\n> old"), ("new\n-- Forwarded message --\nold", "new", "-- Forwarded message --\nold"), ("new\n> a\n> b", "new", "> a\n> b"), ("> a\n> b", "", "> a\n> b"), ("new\n> a\nb", "new\n> a\nb", "")])
def test_segments(spark, text, fresh, quoted):
    got = one(spark, T.segment(L(text)))
    assert (got["fresh"], got["quoted"]) == (fresh, quoted)


def test_paragraphs(spark):
    pack = lambda t, n: one(spark, T.pack_paragraphs(L(t), n))
    assert pack("x" * 10, 10) == ["x" * 10]
    assert pack("x" * 30, 10) == ["x" * 30]
    assert pack("aaaa\n\nbbbb\n\ncccc", 10) == ["aaaa\n\nbbbb", "cccc"]
    assert pack("aaaa\n\nbbbbbbbb\n\n\n\n", 10) == ["aaaa", "bbbbbbbb"]


def test_tokens(spark):
    got = lambda t: one(spark, T.tokenize(L(t)))
    assert got("PO-2024-1847 v1.2. été-x _a_ -- q 你好 7") == ["po-2024-1847", "v1.2", "été-x", "_a_", "q", "你好", "7"]


def test_chunks(spark):
    rows = spark.createDataFrame([("a", "From: x\n\nshort", "s"), ("b", "From: x\nSubject: s\n\n" + "word " * 20, "s"), ("c", "From: x\n\n" + "word " * 20 + "\n> " + "old " * 30 + "\n> more", "s"), ("d", "From: x\n\n" + "word " * 20 + "\n\n[Attachment: a.txt]\n" + "att " * 20 + "\n[Attachment: b.txt]\n" + "b " * 60, "s"), ("e", None, None)], "email_id string, document string, subject string")
    got = {}
    for r in chunks.chunk(rows).collect():
        got.setdefault(r["email_id"], []).append(r["chunk_id"])
    assert got == {"b": ["b_fresh"], "c": ["c_fresh", "c_quoted"], "d": ["d_fresh", "d_att0", "d_att1"]}


def test_ingestion(spark):
    schema = "message_id string, body string, is_read boolean, is_replied boolean, is_flagged boolean, date string"
    seen = ingest.with_keys(spark.createDataFrame([("a", "Hello  there", True, False, False, "1"), ("b", " ", True, False, False, "1")], schema)).select("mid_hash", "body_hash", *ingest.FLAGS)
    news = ingest.with_keys(spark.createDataFrame([("a", "x", True, False, False, "1"), ("a", "x", False, False, False, "1"), ("c", "hello there", True, False, False, "1"), ("d", "", True, False, False, "1"), ("", "fresh", True, False, False, "1")], schema))
    got = sorted((r["message_id"], r["is_read"], r["status"]) for r in ingest.classify(news, seen).collect())
    assert got == [("", True, "new"), ("a", False, "changed"), ("a", True, "duplicate"), ("c", True, "duplicate"), ("d", True, "new")]
    once = ingest.mark_seen(seen, news.dropDuplicates(["mid_hash"]))
    assert once.count() == ingest.mark_seen(once, news).count()


def test_watermarks_never_go_back(spark):
    schema = "account_id string, last_sync_at timestamp_ntz, last_message_date timestamp_ntz, messages_synced long, status string"
    d = datetime(2024, 1, 2), datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", d[0], d[0], 5, "completed"), ("b", d[0], None, 1, "completed")], schema)
    new = spark.createDataFrame([("a", d[1], d[1], 2, "error"), ("b", d[0], d[1], 1, "completed"), ("c", d[0], d[0], 1, "completed")], schema)
    got = {r["account_id"]: tuple(r)[2:] for r in ingest.merge_watermarks(old, new).collect()}
    assert got == {"a": (d[0], 7, "error"), "b": (d[1], 2, "completed"), "c": (d[0], 1, "completed")}


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank long")
    got = {r["id"]: r["rrf_score"] for r in search.fuse([a, b]).collect()}
    assert got == {1: round(1 / 61, 6), 2: round(1 / 61 + 1 / 62, 6), 3: round(1 / 62, 6)}
    assert {r["id"]: r["rrf_score"] for r in search.fuse([b, a]).collect()} == got
    assert search.fuse([a, b.limit(0)]).count() == 2


def test_bm25_of_odd_questions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "red bird"), (3, "red red stone fish"), (4, None)], "doc_id long, text string")
    index = keyword.Index.build(docs.where("doc_id < 4"), f"{tmp_path}/a")
    assert [r["doc_id"] for r in keyword.bm25(index, "bird bird", 5).collect()] == [2]
    assert keyword.bm25(index, "unknown", 5).count() == 0 and keyword.bm25(index, "", 5).count() == 0
    plan = keyword.search(index, "bird", 5).slots()._jdf.queryExecution().executedPlan().toString()
    assert "bird" in plan.split("PushedFilters")[1]  # only the question's terms are read
    assert keyword.bm25(index, "red", 5, docs.where("doc_id = 3").select(F.col("doc_id").alias("id"))).count() <= 1


@pytest.mark.parametrize("counts, want", [([], ["1", "1"]), ([7], ["7", "1"]), ([3, 9], ["9", "1"]), ([1, 2, 3], ["2", "1"]), (list(range(1, 101)), ["67", "34"])])
def test_tier_cutoffs(spark, counts, want):
    got = graph.cutoffs(spark.createDataFrame([(c,) for c in counts], "n long")).first()
    assert [str(got["high"]), str(got["low"])] == want


def test_vectors_without_direction_are_found_by_nobody(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.1])], "id long, embedding array<float>")
    index = VectorIndex.fit(v, f"{tmp_path}/cells")
    assert [(r["query_id"], r["id"]) for r in index.search(v, 1).orderBy("query_id").collect()] == [(1, 1), (4, 4)]
    assert VectorIndex.fit(v.limit(0), f"{tmp_path}/none").search(v, 1).count() == 0


def test_mail_files(spark, tmp_path):
    m = EmailMessage()
    m["Message-ID"], m["From"], m["To"], m["Subject"], m["Date"] = "<x@y>", "Ann Lee <ann@x.org>", "b@x.org, C <c@x.org>", "Grüße", "Tue, 02 Jan 2024 10:00:00 +0100"
    m.set_content("hello")
    m.add_alternative("<p>hello</p>", subtype="html")
    m.add_attachment(b"caf\xe9 notes", maintype="text", subtype="plain", filename="n.txt")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.eml").write_bytes(m.as_bytes())
    (tmp_path / "in" / "sub" / "b.eml").write_bytes(b"\n")
    df = rfc822.read_mail(spark, str(tmp_path / "in"))
    got = {r["message_id"]: r for r in df.collect()}
    r = got["x@y"]
    assert (r["sender"], r["sender_name"], r["recipients_to"], r["subject"], r["body_text"].strip()) == ("ann@x.org", "Ann Lee", ["b@x.org", "c@x.org"], "Grüße", "hello")
    assert r["sent_date"] == datetime(2024, 1, 2, 10) and got[""]["error"] is None
    assert [x["text"] for x in rfc822.attachment_texts(df).collect()] == ["café notes"]


def test_invitations_and_attachments():
    got = rfc822.calendar_fields("BEGIN:VEVENT\nSUMMARY:Plan\n ning\nDTSTART;TZID=x:20240101T100000\nORGANIZER:mailto:a@x\n" + "ATTENDEE;CN=b:mailto:b@x\n" * 12 + "DESCRIPTION:one\\ntwo")
    assert got["summary"] == "Planning" and got["organizer"] == "a@x" and len(got["attendees"]) == 12 and got["details"] == "one\ntwo"
    assert rfc822.extract_text("a.docx", b"broken") == "" and rfc822.extract_text("a.txt", b"\xe9") == "é" and rfc822.extract_text("a.html", b"<p>x</p>") == "x"
    assert rfc822.extract_text("a.png", b"\x89PNG\r\n") == rfc822.extract_text("a.doc", b"\xd0\xcf\x11\xe0") == rfc822.extract_text("noext", b"x") == rfc822.extract_text("a.xls", b"x", "application/vnd.ms-excel") == ""
    assert rfc822.extract_text("noext", b" x ", "text/x-log") == rfc822.extract_text("a.md", b"x", "application/octet-stream") == "x"


class FakeServer:
    def __init__(self, options):
        self.options = options

    def accounts(self):
        return ["a", "b"]

    def folders(self, account):
        return ["INBOX", "Sent", "Junk mail", "[Gmail]/All Mail"]

    def fetch(self, account, folder, since, limit):
        for day in (3, 2, 1)[:limit]:
            if since is None or datetime(2024, 1, day) >= since:
                yield datetime(2024, 1, day), f"Message-ID: <{account}-{folder}-{day}>\nFrom: a@x\n\nhi".encode()


def read_all(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_mail_server_source():
    def rows(**options):
        return sorted((a, f, d.day) for a, f, d, _ in read_all(rfc822.MailServerReader({"connect": f"{__name__}:FakeServer", **options})))

    assert rows(limit="1") == [("a", "INBOX", 3), ("a", "Sent", 3), ("b", "INBOX", 3), ("b", "Sent", 3)]
    assert rows(accounts="b", folders="Sent", since="2024-01-02") == [("b", "Sent", 2), ("b", "Sent", 3)]
    reader = rfc822.PushingMailServerReader({"connect": f"{__name__}:FakeServer", "accounts": "a", "folders": "INBOX"})
    left = list(reader.pushFilters([adapters.GreaterThanOrEqual(("date",), datetime(2024, 1, 3))]))
    assert len(left) == 1 and [d.day for _, _, d, _ in read_all(reader)] == [3]


def test_updates_of_a_stream_replace_older_ones(spark, tmp_path):
    from postloom.streaming import jobs

    for n, rows in enumerate(([("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:00:00")], [("a", "2024-01-01 12:00:00")])):
        spark.createDataFrame(rows, "event_type string, t string").select("event_type", F.col("t").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/in/{n}")
        source = jobs.file_stream(spark, f"{tmp_path}/in/*", "event_type string, ts timestamp_ntz")
        jobs.run_once(jobs.daily_volume(source, late="2 days"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "update")
    got = jobs.latest(spark, f"{tmp_path}/out", "day", "event_type").collect()
    assert sorted((r["event_type"], r["n"]) for r in got) == [("a", 2), ("b", 1)]


class FakeImap:
    def __init__(self, host, port):
        self.log = [(host, port)]

    def login(self, *a):
        self.log.append(a)

    def logout(self):
        pass

    def list(self):
        return "OK", [b'(\\HasNoChildren) "/" "INBOX"', b"() / Trash"]

    def select(self, folder, readonly):
        assert readonly and folder == '"INBOX"'

    def search(self, _, *what):
        return "OK", [b"1 2 3" if what == ("ALL",) else b"3"]

    def fetch(self, n, what):
        assert "PEEK" in what
        return "OK", [(b'%s (INTERNALDATE "0%s-Jan-2024 10:00:00 +0000" BODY[] {3}' % (n, n), b"m" + n)]


def test_imap_client_of_options():
    c = rfc822.ImapClient.from_options({"account_secrets": "gmail:me@x.org:a:b; nowhere:u:p; yahoo:you@y.org:s"})
    assert c.accounts() == ["me@x.org", "you@y.org"] and c.hosts["me@x.org"] == ("imap.gmail.com", 993, "a:b")
    c.connect = FakeImap
    assert [f for f in c.folders("me@x.org") if rfc822.wanted(f)] == ["INBOX"]
    assert [raw for _, raw in c.fetch("me@x.org", "INBOX", None, 2)] == [b"m3", b"m2"]
    assert [raw for _, raw in c.fetch("me@x.org", "INBOX", datetime(2024, 1, 3), None)] == [b"m3"]


def test_archives_desktops_and_calendars(spark, tmp_path):
    import json

    def write(folder, *rows):
        at = tmp_path / f"{folder}.jsonl"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("\n".join(map(json.dumps, rows)))

    day = "2024-01-0{}T10:00:00".format
    write("root/Sent Mail", {"message_identifier": "1", "sender": "bot@x", "delivery_time": day(1), "recipients": [{"address": "a", "kind": 1}, {"address": "b", "kind": 3}], "message_flags": 3, "conversation_topic": "t", "html_body": "<p>x</p>"}, {"internet_message_id": "2", "delivery_time": day(3)})
    write("root/Inbox/Sub", {"message_identifier": "3", "message_flags": 2})
    got = {r["message_id"]: r for r in adapters.read_archive(spark, ("bot@x",), path=str(tmp_path)).collect()}
    a = got["1"]
    assert set(got) == {"1", "2", "3"} and (a["recipients_to"], a["recipients_cc"], a["recipients_bcc"], a["is_read"], a["direction"], a["body"], a["email_type"], a["folder"]) == (["a"], [], ["b"], True, "sent", "x", "meeting_note", "root/Sent Mail")
    assert got["3"]["is_read"] is False and got["3"]["direction"] == "received"
    assert {r["message_id"] for r in adapters.read_archive(spark, path=str(tmp_path), folders="sent", since="2024-01-02").collect()} == {"2"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    late = adapters.read_archive(spark, path=str(tmp_path)).where("received_date >= timestamp_ntz'2024-01-02 00:00:00'")
    assert [r["message_id"] for r in late.collect()] == ["2"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    write("d/Inbox", *({"class": 43 if n != 3 else 26, "entry_id": str(n), "received_time": day(n), "to": " a ; ;b", "unread": n == 1, "last_verb": 101 + n, "flag_status": n, "importance": n % 3} for n in (1, 2, 3, 4)))
    got = {r["message_id"]: r for r in adapters.read_desktop(spark, path=f"{tmp_path}/d", limit="3").collect()}
    assert set(got) == {"4", "2"} and got["2"]["is_replied"] and got["2"]["is_flagged"] and got["2"]["importance"] == "high" and got["2"]["recipients_to"] == ["a", "b"] and got["2"]["is_read"]
    write("c/Calendar", {"class": 26, "subject": "s", "start": day(2), "end": "2024-01-02T11:30:00", "required": "a;b", "optional": "c", "busy_status": 3}, {"class": 26, "start": day(5)}, {"class": 43, "start": day(2)})
    m = adapters.read_calendar(spark, "2024-01-02 00:00:00", "2024-01-05 00:00:00", path=f"{tmp_path}/c").collect()
    assert [(r["subject"], r["duration_minutes"], r["all_attendees"], r["busy_status"]) for r in m] == [("s", 90, ["a", "b", "c"], "out_of_office")]


def test_records_and_pages(spark):
    r = one(spark, items.from_record(L('{"message_id": "a", "direction": "sent", "sent_date": "2024-01-02T03:04:05", "received_date": "soon", "more": 1}')))
    assert (r["message_id"], r["direction"], r["sent_date"], r["received_date"]) == ("a", "sent", datetime(2024, 1, 2, 3, 4, 5), None)
    flat = spark.range(1).select(*items.metadata(F.array(*[L(str(i)) for i in range(7)]), L("s" * 600), L(None).cast("timestamp_ntz"), F.array(*[L(f"f{i}" if i else "") for i in range(12)]))).first()
    assert flat["recipients"] == "0,1,2,3,4" and len(flat["subject"]) == 500 and flat["date"] == "" and flat["attachment_names"].split(",") == [f"f{i}" for i in range(1, 10)]
    assert one(spark, accounts.default_folder(L(" Sent Items "))) == 5 and one(spark, accounts.default_folder(L("x"))) is None


def test_settings():
    assert identity(" A@x.org, ,b@x.org", "gmail:C@x.org:p:q; ;bad") == ("a@x.org", "b@x.org", "c@x.org")
    c = from_settings({"MY_EMAIL_ADDRESSES": "A@x", "RETENTION_DAYS": "30"})
    assert c.addresses == ("a@x",) and c.retention_days == 30 and Config().candidates(20) == 50 and Config().candidates(5) == 20 and Config(most_candidates=None).candidates(200) == 800


def test_scalars(spark):
    assert one(spark, message.conversation_id(F.array(), L(""), L("m"))) == "m"
    assert one(spark, message.importance(L(" 1 (Highest)"))) == "high" and one(spark, message.importance(L(None).cast("string"))) == "normal"
    assert one(spark, message.is_mine(L(" AA@x.com "), ("a@x.com",))) is True
    assert one(spark, T.normalize_subject(L("Re: RE: x"))) == "RE: x" and one(spark, T.normalize_subject(L("FWD: x"))) == "FWD: x"
    assert one(spark, context.clamp_temperature(L(2.0))) == 1.0


def test_hours_are_all_there(spark, small):
    from postloom.plans.views import messages

    assert analytics.hourly(messages(spark, small).limit(0)).agg(F.sum("n")).first()[0] == 0


def test_store_keeps_versions_and_clears_all(spark, tmp_path):
    from postloom.operators.store import Store

    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("messages") is None
    s.write("messages", spark.range(3))
    s.write("messages", s.read("messages").where("id > 0"))
    assert s.read("messages").count() == 2 and s.versions("messages") == [0, 1]
    s.write("chunks", spark.createDataFrame([("c1", "a b a")], "chunk_id string, text string"))
    assert s.index().postings.count() == 2 and s.index().version == 0 and s.refresh_index().version == 0
    kept = s.days("messages", key="id", date=None).remove(spark.range(2))
    assert [r["id"] for r in s.days("messages").read().collect()] == [2] and kept.version == 1
    s.clear()
    assert s.read("messages") is None and s.versions("index") == []
    with pytest.raises(FileNotFoundError):
        s.days("messages")


def test_failed_answers_keep_the_others(spark):
    def load():
        def model(p):
            if "bad" in p:
                raise ValueError("no")
            return p.upper()

        return model

    got = {r["ask_id"]: (r["answer"], r["error"]) for r in context.answers(spark.createDataFrame([("1", "ok"), ("2", "bad")], "ask_id string, prompt string"), load).collect()}
    assert got == {"1": ("OK", None), "2": ("", "ValueError: no")}


def test_nothing_is_cut_before_chunking(spark):
    opening = "the same words again and again " * 100
    a, b = ingest.with_keys(spark.createDataFrame([("a", opening + "one"), ("b", opening + "two")], "message_id string, body string")).collect()
    assert len(opening) > 3000 and a["body_hash"] != b["body_hash"]
    body = "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(100)) + "\n\nthe last words of all"
    m = spark.createDataFrame([("m", "s", body)], "email_id string, subject string, body string")
    none = F.array().cast("array<struct<filename:string,text:string>>")
    keys = {k: L("") for k in ("email_type", "sender", "sender_name", "folder")} | {"recipients": F.array(), "subject": F.col("subject"), "date": L(None).cast("timestamp_ntz"), "body": F.col("body"), "attachments": none}
    got = chunks.chunk(m.select("email_id", "subject", message.document(keys).alias("document"))).collect()
    assert len(body) > 20_000 and any("the last words of all" in r["text"] for r in got) and max(len(r["text"]) for r in got) <= 800
    assert len(chunks.chunk(m.select("email_id", "subject", message.document(keys, most_body=5000).alias("document"))).collect()) < len(got)
    short = spark.createDataFrame([("e", "s", "> a\n> b\n\n" + "\n\n".join(["-- "] + ["x" * 500] * 4))], "email_id string, subject string, document string")
    assert sum(r["text"].count("x") for r in chunks.chunk(short).collect()) == 2000
    q = spark.createDataFrame([(1, "a " * 2000 + "needle"), (2, "a b")], "id long, text string")
    assert [r["id"] for r in search.rerank(q, "needle a", 1).collect()] == [1]
    items_ = graph.action_items(spark.createDataFrame([("m", "p@x", "\n".join(f"TODO: thing {i} " + "y" * 200 for i in range(9)), "1")], "message_id string, sender string, body string, date string"), None, None).collect()
    assert len(items_) == 9 and all(len(r["item"]) > 200 for r in items_)


def test_quotes_are_counted_by_message(spark):
    rows = [("a", "1", "> x > y", False), ("a", "2", "none", True), ("a", "3", "." * 199 + ">", True), ("a", "4", "." * 200 + ">", False), ("", "5", ">", True)]
    m = spark.createDataFrame(rows, "conversation_id string, message_id string, document string, is_replied boolean")
    assert [tuple(r) for r in graph.thread_counts(m).collect()] == [("a", 2, 2)]
    assert graph.thread_counts(m, None).first()["quotes"] == 3


def test_pairs_of_a_long_thread_are_all_there(spark):
    n = 200
    rows = [("long", f"p{i:03}@x", f"m{i}", "", False, ">") for i in range(n)] + [("two", "p000@x", "q", "", True, ""), ("two", "p001@x", "r", "", True, "")]
    m = spark.createDataFrame(rows, "conversation_id string, sender string, message_id string, email_type string, is_replied boolean, document string")
    pairs = graph.person_pairs(m)
    assert pairs.count() == n * (n - 1) // 2
    assert tuple(pairs.where("weight = 2").first()) == ("p000@x", "p001@x", 2, 2, n)
    assert {r["conversation_id"] for r in graph.pair_threads(m).where("src = 'p000@x' and dst = 'p001@x'").collect()} == {"long", "two"}


def test_a_batch_changes_the_edges_of_its_threads_only(spark, tmp_path):
    from postloom.operators.manifest import Conflict

    row = lambda t, p, i, replied=False, text="": (t, p, f"m{i}", "", replied, text)
    shape = "conversation_id string, sender string, message_id string, email_type string, is_replied boolean, document string"
    first = [row(f"t{k}", f"p{j}@x", 10 * k + j) for k in range(30) for j in range(4)] + [row("", "p1@x", 999), row(None, "p2@x", 998)]
    view = graph.EdgeView(spark, f"{tmp_path}/v")
    assert view.edges.count() == 0 and view.add(spark.createDataFrame(first, shape), "one")
    more = [row("t3", "new@x", 1000, True, ">"), row("t3", "p0@x", 1001)]
    assert view.add(spark.createDataFrame(more, shape), "two") and not view.add(spark.createDataFrame(more, shape), "two")
    every = spark.createDataFrame(first + more, shape)
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", "weight", "replies", "quotes").collect()))
    assert rows(view.edges) == rows(graph.person_pairs(every))
    assert spark.read.parquet(f"{tmp_path}/v/two/changes").count() == 10 and spark.read.parquet(f"{tmp_path}/v/two/members").count() == 1
    stale = graph.EdgeView(spark, f"{tmp_path}/v")._manifest()
    with pytest.raises(Conflict):
        stale.commit(0, {})


def test_spans_of_time_are_half_open(spark):
    m = spark.createDataFrame([("2024-01-15 00:00:00",), ("2024-01-21 23:59:59",), ("2024-01-22 00:00:00",)], "date string").select(F.col("date").cast("timestamp_ntz").alias("date"))
    assert m.where(filters.compile_filter(filters.build_where({}, filters.time_range("last week", WED)))).count() == 2


def test_summaries_keep_all_if_asked(spark):
    rows = [("c", f"m{i:03}", f"2024-01-01 00:{i // 60:02}:{i % 60:02}", "n" + str(i % 9), "s", "sent", "hello " * 10) for i in range(120)]
    m = spark.createDataFrame(rows, "conversation_id string, message_id string, d string, sender string, subject string, direction string, body string").select("*", F.col("d").cast("timestamp_ntz").alias("date"), F.lit("").alias("sender_name"))
    short, whole = (chunks.summaries(m, *a).first()["text"] for a in ((), (None, None)))
    assert len(short) == 1200 and whole.count("hello hello") >= 120 and whole.startswith(short.split("Participants")[0]) and "n8" in whole


def test_duplicates_are_decided_by_their_values(spark):
    schema = "mid_hash string, body_hash string, is_read boolean, is_replied boolean, is_flagged boolean"
    seen = spark.createDataFrame([("a", "h", False, False, False), ("a", "h", True, False, False)], schema)
    new = spark.createDataFrame([("a", "h", True, False, False)], schema)
    for part in (1, 5):
        assert ingest.classify(new, seen.repartition(part)).first()["status"] == "duplicate"
    out = ingest.update_flags(seen.select("mid_hash", *ingest.FLAGS), spark.createDataFrame([("a", None, True, None), ("a", None, False, None)], "mid_hash string, is_read boolean, is_replied boolean, is_flagged boolean"), "mid_hash").collect()
    assert all(r["is_replied"] for r in out) and sorted(r["is_read"] for r in out) == [False, True]
    assert ingest.insert_new(seen.limit(0), seen, "mid_hash").first()["is_read"] is False


def test_clicks_find_messages_by_words(spark, tmp_path):
    m = spark.createDataFrame([(f"m{i}", f"h{i}", s) for i, s in enumerate(["Budget plan", "the PLAN b", None, "ab", "plan", "plan"])], "message_id string, header_id string, subject string")
    asked = [("1", "m4", None, None), ("2", "x", "h3", "plan"), ("3", None, None, "Plan"), ("4", None, None, "b"), ("5", None, None, "zz"), ("6", None, None, "lan b"), ("7", None, None, ""), ("8", None, None, "t p")]
    subjects = TrigramIndex.build(m, f"{tmp_path}/subjects", "message_id", "subject")
    got = {r["ask_id"]: r["message_id"] for r in store.open_cascade(spark.createDataFrame(asked, "ask_id string, id string, header_id string, words string"), m, subjects).collect()}
    assert got == {"1": "m4", "2": "m3", "3": "m0", "4": "m0", "5": None, "6": "m1", "7": None, "8": "m0"}


def test_failed_calls_of_an_extraction_stop_nothing(spark):
    m = spark.createDataFrame([(f"m{i}", f"text {i}") for i in range(40)] + [("none", None)], "message_id string, text string")

    def model(p):
        if "text 7" in p:
            raise ConnectionError("down")
        if "text 1\n" in p and p.startswith("---"):
            return "not json"
        return '{"email_index": 0, "sentiment": "x"}'

    rows = facts.extract(m, model).collect()
    assert sorted(r["email_id"] for r in rows) == sorted(r["message_id"] for r in m.collect())
    errors = {r["error"].split(":")[0] for r in rows if r["error"]}
    assert "ConnectionError" in errors and all((r["answer"] is None) == (r["error"] is not None) for r in rows)
    assert facts.run_extraction(m, spark.createDataFrame([], f"email_id string, card {facts.CARD}"), model).count() == sum(r["answer"] is not None for r in rows)


def test_prompts_that_never_fit(spark):
    def load():
        def model(p):
            raise context.Overflow("too long") if "MESSAGES" in p else ValueError("no")

        return model

    ms = [("m1", "1", "a"), ("m2", None, None)]
    q = spark.createDataFrame([("1", "q", ms), ("2", "q", []), ("3", "q", None)], "ask_id string, question string, messages array<struct<message_id:string,date:string,text:string>>")
    got = {r["ask_id"]: r for r in context.ask(q, load).collect()}
    assert all(r["answer"] == "" and r["attempts"] == 4 and r["error"] == "Overflow: too long" for r in got.values())
    events = context.answer_events(context.ask(q, lambda: lambda p: "x" * 100)).orderBy("ask_id", "event_no").collect()
    assert [r["event"] for r in events if r["ask_id"] == "1"][-2:] == ['data: {"ask_id":"1","place":2000000000,"type":"ref_map","content":"{\\"SRC-1\\":\\"m1\\",\\"SRC-2\\":\\"m2\\"}"}\n\n', "data: [DONE]\n\n"]


def test_retrieval_of_few_and_many(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"word{i % 3} common text {i}", "received" if i % 2 else "sent") for i in range(60)], "id string, document string, direction string")
    vectors = docs.select("id", F.array(F.lit(1.0), F.length("document") / 100).alias("embedding"))
    corpus = retrieval.Corpus(docs, vectors, keyword.Index.build(docs, f"{tmp_path}/i", "id", "document"))
    hits = retrieval.retrieve(corpus, "word1", [1.0, 0.0], 5, {"direction": "received"}).collect()
    assert len(hits) == 5 and {int(r["id"][1:]) % 2 for r in hits} == {1} and all(r["rerank_score"] is not None for r in hits)
    few = retrieval.retrieve(corpus, "word1", [1.0, 0.0], 60, {"direction": "received"}).collect()
    assert len(few) == 30 and all(r["rerank_score"] is None for r in few) and [r["rrf_score"] for r in sorted(few, key=lambda r: r["place"])] == sorted((r["rrf_score"] for r in few), reverse=True)
    assert len(retrieval.retrieve(corpus, "word1", [1.0, 0.0], 5, {"direction": "nowhere"}).collect()) == 5  # the branch of vectors drops a filter that leaves nothing
    assert all(r["relevance"] > 0.99 for r in retrieval.retrieve(corpus, "word1", [1.0, 0.0], 5, above=0.99).collect())
    messages = docs.select(F.col("id").alias("message_id"), F.when(F.col("id") < "d3", "t").otherwise("").alias("conversation_id"))
    assert retrieval.with_threads(messages, spark.createDataFrame([("d1",), ("d5",)], "id string")).count() == messages.where("conversation_id = 't'").count() + 1


def test_backends(spark):
    def down():
        raise OSError

    r = backends.Registry().with_backend(backends.Backend("a", "A", lambda: str.upper, models=lambda: ["m"])).with_backend(backends.Backend("b", "B", lambda: str.lower, health=down, models=down))
    assert [tuple(x) for x in r.status(spark).collect()] == [("a", "A", True, ["m"]), ("b", "B", False, [])]
    assert r.get().id == "a" and r.get("b").load()("X") == "x" and r.with_temperature(7).get("b").temperature == 1.0
    with pytest.raises(KeyError):
        r.get("c")


def test_calls_from_a_meeting_a_topic_or_a_question_to_messages(spark, tmp_path):
    from postloom.operators import assist, keyword

    rows = [(f"m{i}", "" if i == 9 else f"t{i // 3}", f"{w} notes of {i}", "received" if i % 2 else "sent", i % 3 == 0, i % 2 == 0, i) for i, w in enumerate(["budget", "budget", "trip", "trip", "offer", "offer", "mary", "mary", "lunch", "summary"])]
    m = spark.createDataFrame(rows, "message_id string, conversation_id string, body string, direction string, is_replied boolean, is_read boolean, day int")
    m = m.select("*", F.lit("a@b.org").alias("sender"), F.lit("").alias("sender_name"), F.lit("s").alias("subject"), F.lit("").alias("email_type"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("date"))
    index = keyword.Index.build(m, f"{tmp_path}/i", "message_id", "body")
    docs = m.select(F.col("message_id").alias("id"), F.col("body").alias("document"), "direction", "is_replied", "is_read", "date")
    vectors = m.select(F.col("message_id").alias("id"), F.array(F.lit(1.0), F.col("day").cast("double")).alias("embedding"))
    box = assist.Mailbox(m, assist.Corpus(docs, vectors, index), lambda q: [1.0, 0.0])
    nothing = assist.for_meeting(box, "", ["", None])
    assert nothing.hits.count() == 0 and nothing.messages.count() == 0
    found = assist.for_meeting(box, "budget", ["mary", "", "lunch", "offer"], config=Config(over_fetch=1))
    hits = [(r["id"], r["query_no"]) for r in found.hits.orderBy("place").collect()]
    assert [r["place"] for r in found.hits.orderBy("place").collect()] == list(range(1, len(hits) + 1)) and len({i for i, _ in hits}) == len(hits)
    assert {q for _, q in hits} <= {1, 2, 3, 4} and {i for i, _ in hits} >= {"m0", "m1", "m6", "m8"}
    assert {r["message_id"] for r in found.messages.where("hit_rank is not null").collect()} == {i for i, _ in hits}
    one = assist.answered(box, "unread budget", datetime.fromisoformat("2024-01-25"), lambda: lambda p: f"{p.count('SRC-')} read", n=2, local=True).first()
    assert (one["query_type"], one["attempts"], one["error"]) == ("unread", 1, None) and one["answer"] == f"{len(one['refs'])} read" and one["emails_found"] == 2
    silent = assist.answered(box, "unread", datetime.fromisoformat("2024-01-25"), lambda: lambda p: 1 / 0, n=2).first()
    assert silent["answer"] == "" and silent["error"].startswith("ZeroDivisionError")
    places = [r["place"] for r in assist.sources(box, found, 3).orderBy("place").collect()]
    assert places == [1, 2, 3]
    part = assist.entity_map(box, "budget", n=4)
    assert part.hits.where("relevance <= 0.45").count() == 0 and part.messages.count() >= part.hits.count()


@pytest.mark.parametrize("size", [1 << 20, 12])
def test_phrases_are_found_as_by_a_search_for_each(spark, monkeypatch, size):
    from postloom.operators import phrases

    monkeypatch.setattr(phrases, "PART_BYTES", size)
    texts = [("a", "He said: No Response yet, no"), ("b", None), ("c", ""), ("d", "İstanbul ÉTÉ aaaa"), ("d", "aaaa no response"), (None, "response")]
    table = [("no response", "w"), ("response", "r"), ("NO", "n"), ("aa", "x"), ("aa", "y"), ("été", "z"), ("", "never"), (None, "never"), ("said", None)]
    rows, known = spark.createDataFrame(texts, "k string, body string"), spark.createDataFrame(table, "phrase string, tag string")
    want = sorted({(k, t) for k, x in texts for p, t in table if x and p and t and p.lower() in x.lower()}, key=repr)
    assert sorted({tuple(r) for r in phrases.tagged(rows, known, "k").collect()}, key=repr) == want
    assert phrases.tagged(rows, known.limit(0), "k").count() == 0 and phrases.tagged(rows.limit(0), known, "k").count() == 0


def test_hashed_embeddings_are_counts_by_place(spark):
    import hashlib
    import math

    from postloom.operators.embed import hashed

    text = "the plan, the Plan and 12 budgets"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    got = {r["doc_id"]: list(r["embedding"]) for r in hashed(rows, size=16).collect()}
    tokens = spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t"))).first()[0]
    want = [0] * 16
    for t in tokens:
        want[hashlib.md5(t.encode()).digest()[0] % 16] += 1
    length = math.sqrt(sum(n * n for n in want))
    assert len(tokens) >= 6 and [round(x * length, 9) for x in got[1]] == want and got[2] == got[3] == got[4] == [0.0] * 16


def test_rows_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(context, "RANGES", 3)
    rows = [(i % 7, None if i % 11 == 0 else f"v{i % 13}", "x") for i in range(200)]
    got = context.in_order(spark.createDataFrame(rows, "a int, b string, n string").repartition(5), ("b",)).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["row_no"])] == want and sorted(r["row_no"] for r in got) == list(range(1, 201))
    assert context.as_events(spark.createDataFrame([], "a int")).count() == 0
