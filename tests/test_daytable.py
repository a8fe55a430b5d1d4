"""The table by day against plain rows."""

import os
from datetime import datetime, timedelta

import pytest

from postloom.operators.daytable import UNDATED, DayTable
from postloom.operators.manifest import Conflict

SHAPE = "message_id string, is_read boolean, is_replied boolean, is_flagged boolean, date timestamp_ntz, day string"
START = datetime(2024, 1, 1)


def rows_of(n):
    """Six a day, one of 17 undated, one of 23 without an id; `day` clashes with a name of the table's own."""
    return [(None if i % 23 == 22 else f"m{i}", i % 2 == 0, False, i % 3 == 0, None if i % 17 == 16 else START + timedelta(hours=4 * i), "x") for i in range(n)]


def content(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def parts(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_changes_equal_plain_rows(spark, tmp_path):
    rows = rows_of(120)
    frame = lambda part: spark.createDataFrame(part, SHAPE)
    t = DayTable.create(frame(rows[:100]), f"{tmp_path}/t", "message_id")
    assert content(t) == sorted(rows[:100], key=repr) and UNDATED in t.days()
    t = t.insert(frame([r for r in rows[90:] if r[0]]))
    want = rows[:100] + [r for r in rows[100:] if r[0]]
    assert content(t) == sorted(want, key=repr)
    news = [("m3", True, None, None), ("m5", True, None, None), ("m16", None, True, None), ("m4", True, None, None), ("none", True, True, True)]
    t = t.update_flags(spark.createDataFrame(news, "message_id string, is_read boolean, is_replied boolean, is_flagged boolean"))
    assert sum(n for p in t.content["gone"] for n in p["days"].values()) == 3  # m4 was read before
    want = [(r[0], True, *r[2:]) if r[0] in ("m3", "m5") else (*r[:2], True, *r[3:]) if r[0] == "m16" else r for r in want]
    assert content(t) == sorted(want, key=repr)
    t = t.remove(frame([r for r in rows if r[0] in ("m7", "m33", "m50")]))
    want = [r for r in want if r[0] not in ("m7", "m33", "m50")]
    assert content(t) == sorted(want, key=repr)
    t = t.append(frame([rows[7], rows[8]]))  # a removed key comes back, a present one is there twice
    want += [rows[7], rows[8]]
    assert content(t) == sorted(want, key=repr)
    old = t
    t = t.append(frame([(None, *rows[12][1:]), (None, *rows[17][1:])]))  # without ids, on both sides of the cut
    want += [(None, *rows[17][1:])]
    t = t.retain("2024-01-11 10:00:00", 8)
    want = [r for r in want if r[4] is None or r[4] >= datetime(2024, 1, 3, 10)]
    assert content(t) == sorted(want, key=repr) and min(t.days()) == "2024-01-03"
    assert content(t.compact()) == content(t)
    t = DayTable.load(spark, f"{tmp_path}/t")
    assert not t.content["gone"] and content(t) == sorted(want, key=repr) and t.compact() is t
    assert content(DayTable.load(spark, f"{tmp_path}/t", old.version)) == content(old)
    folders = lambda: {(os.path.basename(d)[len("stored_part=") :], n[len("stored_day=") :]) for d, names, _ in os.walk(f"{tmp_path}/t") for n in names if n.startswith("stored_day=")}
    named = {(p["name"], d) for p in t.content["rows"] for d in p["days"]}
    assert folders() > named and content(t.vacuum()) == sorted(want, key=repr) and folders() == named


def test_what_is_written_follows_what_changes(spark, tmp_path):
    wide = spark.range(20_000).selectExpr("concat('m', id) message_id", "false is_read", "false is_replied", "false is_flagged", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id div 2000 as int)) date", "sha2(cast(id as string), 512) text").coalesce(1)
    t = DayTable.create(wide, f"{tmp_path}/t", "message_id")
    before = parts(tmp_path)
    t = t.update_flags(wide.where("message_id in ('m1', 'm2')").selectExpr("message_id", "true is_read", "is_replied", "is_flagged"))
    assert parts(tmp_path) - before < 0.02 * before and t.read().where("is_read").count() == 2 and t.read().count() == 20_000
    t = t.retain("2024-01-15 00:00:00", 10)  # on a day's edge nothing is written
    assert parts(tmp_path) - before < 0.02 * before and t.read().count() == 12_000 and len(t.days()) == 6
    plan = lambda day: t.read([day])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan("2024-01-06") and "Join" not in plan("2024-01-01")


def test_of_two_writers_one_fails(spark, tmp_path):
    frame = spark.createDataFrame(rows_of(20), SHAPE)
    t = DayTable.create(frame, f"{tmp_path}/t", "message_id")
    first = t.remove(frame.where("message_id = 'm1'"))
    with pytest.raises(Conflict):
        t.remove(frame.where("message_id = 'm2'"))
    assert content(DayTable.load(spark, f"{tmp_path}/t")) == content(first)


def test_table_of_nothing(spark, tmp_path):
    t = DayTable.create(spark.createDataFrame([], SHAPE), f"{tmp_path}/t", "message_id")
    assert content(t) == [] and t.retain("2024-01-11 10:00:00", 8).read().count() == 0 and t.remove(t.read()) is t and t.compact() is t
    undated = DayTable.create(spark.createDataFrame([("a", 1), ("b", 2)], "email_id string, n int"), f"{tmp_path}/u", "email_id", None)
    assert [r["n"] for r in undated.remove(spark.createDataFrame([("a",)], "email_id string")).read().collect()] == [2]
