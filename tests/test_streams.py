"""Keyed state of streams with a handle that stands in for Spark's, and the mailbox source by itself. The queries run them in streams."""

import datetime

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from postloom.sources.mailbox_stream import MailboxReader
from postloom.streaming import stateful


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema, ttl=None):
        return State()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    getExpiryTimeInMs = getCurrentWatermarkInMs


def made(processor):
    processor.handle_for_test = Handle()
    processor.init(processor.handle_for_test)
    return processor


def rows(*items):
    """(place, message_id, is_read, body_hash)"""
    return pd.DataFrame([(p, m, m, r, False, False, b, "candidate") for p, m, r, b in items], columns=["place", "message_id", "mid_hash", "is_read", "is_replied", "is_flagged", "body_hash", "status"])


def said(processor, *parts):
    out = [(r["place"], r["status"]) for p in processor.handleInputRows(("k",), iter(parts), None) for _, r in p.iterrows()]
    assert sorted(p for p, _ in out) == sorted(p for part in parts for p in part["place"])  # each row once
    return dict(out)


def test_rows_of_an_id():
    p = made(stateful._ById(1))
    assert said(p, rows(("c", "m", True, "b"), ("a", "m", False, "b")), rows(("b", "m", False, "b"))) == {"a": "candidate", "b": "duplicate", "c": "changed"}
    assert said(p, rows(("d", "m", True, "b"))) == {"d": "duplicate"}
    assert said(p, rows(("e", "m", False, "b"), ("f", "m", True, "x"))) == {"e": "duplicate", "f": "duplicate"}  # what an epoch ends with counts
    assert said(p, rows(("g", "m", False, "b"))) == {"g": "changed"}
    one = made(stateful._ById(1))
    assert said(one, rows(("a", "m", True, "b"))) == {"a": "candidate"} and said(one, rows(("a", "m", True, "b"))) == {"a": "duplicate"}
    none = made(stateful._ById(1))
    assert said(none, rows(("a", None, True, "b"), ("b", None, True, "b"))) == {"a": "candidate", "b": "candidate"} and not none.flags.exists()


def test_rows_of_a_body():
    p = made(stateful._ByBody(1))
    known = rows(("z", "q", True, "b")).assign(status="changed")
    assert said(p, pd.concat([rows(("c", "m3", True, "b")), known]), rows(("a", "m1", True, "b"), ("b", "m2", True, "b"))) == {"a": "new", "b": "duplicate", "c": "duplicate", "z": "changed"}
    assert said(p, rows(("d", "m4", True, "b"))) == {"d": "duplicate"}
    none = made(stateful._ByBody(1))
    assert said(none, rows(("a", "m", True, None), ("b", "n", True, None))) == {"a": "new", "b": "new"} and not none.seen.exists()


def thread_rows(*items):
    return pd.DataFrame(items, columns=["message_id", "ms", "mine", "is_replied", "email_type"])


def test_threads_turn_stale_by_timers():
    day, p = stateful.DAY_MS, made(stateful._Thread(14))
    timers = p.handle_for_test.timers
    told = lambda out: [(r["message_id"], r["message_count"], r["all_notes"], r["state"], r["version"]) for d in out for _, r in d.iterrows()]
    assert told(p.handleInputRows(("t",), iter([thread_rows(("m2", 2 * day, False, False, ""), ("m1", day, True, True, "meeting_note"))]), Clock(0))) == [("m2", 2, False, "needs_action", 1)]
    assert timers == {16 * day + 1}
    assert told(p.handleInputRows(("t",), iter([thread_rows(("m0", day, True, False, "")), thread_rows(("m3", 3 * day, True, False, ""))]), Clock(2 * day))) == [("m3", 4, False, "awaiting_response", 2)]
    assert timers == {17 * day + 1}
    assert told(p.handleExpiredTimer(("t",), None, Clock(16 * day + 1))) == []
    assert told(p.handleExpiredTimer(("t",), None, Clock(17 * day + 1))) == [("m3", 4, False, "stale", 3)]
    late = made(stateful._Thread(14))
    assert told(late.handleInputRows(("t",), iter([thread_rows(("m", day, False, True, "meeting_note"))]), Clock(15 * day + 1))) == [("m", 1, True, "stale_needs_action", 1)]
    assert not late.handle_for_test.timers


@pytest.mark.parametrize("kind", [pa.timestamp("us"), pa.timestamp("ms"), pa.timestamp("us", "UTC")])
def test_offsets_are_watermarks(tmp_path, kind):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)

    def deliver(account, name, *hours):
        (tmp_path / account).mkdir(exist_ok=True)
        pq.write_table(pa.table({"message_id": [f"{name}{h}" for h in hours], "date": pa.array([at(h) for h in hours]).cast(kind)}), tmp_path / account / f"{name}.parquet")

    schema = T.StructType([T.StructField("account", T.StringType()), T.StructField("message_id", T.StringType()), T.StructField("date", T.TimestampNTZType())])
    reader = MailboxReader({"path": str(tmp_path), "since": "2024-01-01T01:00:00"}, schema)
    assert reader.initialOffset() == {} and MailboxReader({"path": f"{tmp_path}/none"}, schema).latestOffset() == {}
    deliver("a", "x", 0.5, 2, 5)
    deliver("b", "y", 3)
    (tmp_path / "empty").mkdir()
    got = lambda start, end: sorted((r["account"], r["message_id"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist())
    one = reader.latestOffset()
    assert sorted(one) == ["a", "b"] and got({}, one) == [("a", "x2"), ("a", "x5"), ("b", "y3")]
    assert reader.partitions(one, one) == []
    deliver("a", "late", 3.5, 4.5, 6)
    two = reader.latestOffset()
    assert two["b"] == one["b"] and got(one, two) == [("a", "late4.5"), ("a", "late6"), ("a", "x5")]  # an hour is read again
    assert got({}, one) == [("a", "late3.5"), ("a", "late4.5"), ("a", "x2"), ("a", "x5"), ("b", "y3")]
