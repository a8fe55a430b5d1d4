"""Each operator against a plain version of itself or the library it must agree with, on real rows and on edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postloom.llm import byte_bpe, catalog, chat, components, decontaminate, near_dedup, packing, pii, quality, secrets, substring_dedup, superminhash, token_counts
from postloom.llm.common import Words, mix

DOCS = "doc_id long, text string"
LONG = "lorem ipsum dolor sit amet " * 30_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "no id at all"), (7, LONG), (8, "é́ 你好 🎉 " * 30), (8, "é́ 你好 🎉 " * 30)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).withColumn("h", F.lit(1)).withColumn("path", F.lit("x")).withColumn("r", F.lit("y"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- words ------------------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="aB \n\té\x0b\x1c", max_size=12), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), bounds, False)
    want = [(i, x) for i, t in enumerate(raw) for x in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    data = b"".join(raw)
    assert [(d, data[a:b]) for d, a, b in zip(w.doc, w.start, w.end)] == want
    h = w.hashes()
    same = {}
    for (_, x), v in zip(want, h.tolist()):
        assert same.setdefault(x, v) == v
    assert len(set(same.values())) == len(same)


# --- 1: pseudonyms ------------------------------------------------------------------------------


def plain_feistel(values, radices, key, tweak):
    half = (len(values) + 1) // 2
    a, b, ma, mb = values[:half], values[half:], radices[:half], radices[half:]
    for r in range(pii.ROUNDS):
        own, other, m = (a, b, ma) if r % 2 == 0 else (b, a, mb)
        seed = "|".join([key, tweak, str(r), ",".join(map(str, other))])
        own = [(v + int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)) % m[i] for i, v in enumerate(own)]
        a, b = (own, b) if r % 2 == 0 else (a, own)
    return a + b


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * v, 10)) for v in d[1::2])


def test_domains_of_addresses(spark):
    """Personal domains go, equal ones stay linked whatever their case, providers and public suffixes stay."""
    hosts = ["janedoe-family.org", "JaneDoe-Family.org", "jane.doe.co.uk", "co.uk", "gmail.com", "Gmail.com", "x.y.com.com"]
    rows = spark.createDataFrame([(i, f"me@{h}") for i, h in enumerate(hosts)], DOCS)
    got = [r["text"].split("@")[1] for _, r in sorted(rows_by_id(pii.pseudonymize(rows, "k")).items())]
    for h, g, kept in zip(hosts, got, [".org", ".org", ".co.uk", ".uk", "gmail.com", "Gmail.com", ".com"]):
        assert g.endswith(kept) and len(g) == len(h) and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", g)) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", h))
        assert (g == h) == (h == kept)
    assert got[0] == got[1].lower() and got[0] != got[1]


def test_pseudonyms_keep_formats_and_links(spark):
    text = "a.b+1@mail.example.com 4111111111111111 4111 1111 1111 1111 4111111111111112 +1 (724) 555-7058 123-45-6789 10.20.30.40 2024-02-29 31.12.1999 29/02/2023 1.2.3 v10.20.30.40.5"
    rows = spark.createDataFrame([(1, text), (2, "see 4111111111111111, mail a.b+1@mail.example.com."), (3, None), (4, ""), (5, "nothing 12 here")], DOCS)
    got = rows_by_id(pii.pseudonymize(rows, "k"))
    out = got[1]["text"]
    parts = re.fullmatch(r"([a-z])\.([a-z])\+(\d)@(?!mail)[a-z]{4}\.(?!example)[a-z]{7}\.com (4\d{15}) (4\d{3}(?: \d{4}){3}) 4111111111111112 (\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}) (\d{3}-\d\d-\d{4}) ((?:\d+\.){3}\d+) (\d{4}-\d\d-\d\d) (\d\d\.\d\d\.\d{4}) 29/02/2023 1\.2\.3 v10\.20\.30\.40\.5", out)
    assert parts, out
    assert luhn(parts[4]) % 10 == 0 and luhn(parts[5].replace(" ", "")) % 10 == 0
    assert parts[4] != "4111111111111111" and parts[8] != "10.20.30.40" and parts[9] != "2024-02-29"
    assert f"see {parts[4]}," in got[2]["text"] and out.split()[0] in got[2]["text"]
    assert got[1]["n_values"] == 8 and got[1]["kinds"]["card"] == 2 and got[2]["n_values"] == 2
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "nothing 12 here" and got[5]["kinds"] == {}
    again = rows_by_id(pii.pseudonymize(rows, "other"))
    assert again[1]["text"] != out


def test_feistel_is_the_plain_one_and_a_bijection(spark):
    days = spark.range(0, 3000).select((F.col("id") * 24 % 72684).alias("d")).distinct()
    slots = F.array(pii._slot(F.floor(F.col("d") / 673), 108, 0), pii._slot(F.col("d") % 673, 673, 0))
    got = days.select("d", pii.feistel(slots, "k", "date").alias("s")).collect()
    assert len({(r["s"][0]["v"], r["s"][1]["v"]) for r in got}) == len(got)
    for r in got[:100]:
        assert [x["v"] for x in r["s"]] == plain_feistel([r["d"] // 673, r["d"] % 673], [108, 673], "k", "date")


#: The same value in several layouts.
LAYOUTS = [
    ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
    ["378282246310005", "3782 822463 10005"],
    ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00"],
    ["(724) 555-7058", "724-555-7058", "724.555.7058", "724 555 7058", "+1 724 555 7058", "+17245557058", "+1 (724) 555-7058"],
    ["+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "0033 1 23 45 67 89", "+33123456789", "01 23 45 67 89", "01.23.45.67.89"],
    ["+34 612 34 56 78", "612 34 56 78", "+34612345678"],
    ["+49 30 1234567", "+49 (0)30 1234567", "030 1234567", "(030) 1234567"],
    ["1984-02-21", "21.02.1984", "21/02/1984"],
]


def test_values_stay_linked_in_all_layouts(spark):
    flat = [(k, v) for k, vs in enumerate(LAYOUTS) for v in vs]
    out = rows_by_id(pii.pseudonymize(spark.createDataFrame([(i, f"x {v} y") for i, (_, v) in enumerate(flat)], DOCS), "k"))
    digits = lambda v: re.sub(r"^(\+33|0033|\+34|\+49|\+1|(?<!\d)\(?0(?=\d*\D))|\(0\)|[^0-9A-Z]", "", re.sub(r"(?<=\d) ?\(0\)", "", v))
    for k, vs in enumerate(LAYOUTS):
        news = [out[i]["text"][2:-2] for i, (j, _) in enumerate(flat) if j == k]
        assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) and a != b for a, b in zip(vs, news))
        if k == 7:
            news = [news[0], "-".join(news[1].split(".")[::-1]), "-".join(news[2].split("/")[::-1])]
        assert len({digits(v) for v in news}) == 1, news


def test_plans_do_not_show_the_key(spark, edges):
    out = pii.pseudonymize(edges, "a-very-secret-key")
    assert "very-secret" not in out._jdf.queryExecution().toString() and out.count() == len(EDGES)


def test_pseudonyms_of_edges(spark, edges, empty):
    got = pii.pseudonymize(edges, "k").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i or 0, t or "") for i, t in EDGES)
    assert pii.pseudonymize(empty, "k").count() == 0
    same = pii.pseudonymize_documents(edges.withColumn("n_chars", F.lit(0)), "k")
    assert same.columns == [*edges.columns, "n_chars"] and same.count() == len(EDGES)


def mod97(iban):
    plain = re.sub("[ -]", "", iban)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


#: Value, kind, and the form that its pseudonym must have.
USUAL = [
    ("+33 1 23 45 67 89", "phone", r"\+33 [1-9](?: \d\d){4}"),
    ("+33 (0)1 23 45 67 89", "phone", r"\+33 \(0\)[1-9](?: \d\d){4}"),
    ("0033 1 23 45 67 89", "phone", r"0033 [1-9](?: \d\d){4}"),
    ("+34 612 34 56 78", "phone", r"\+34 [1-9]\d\d(?: \d\d){3}"),
    ("+49 (0)30 123456", "phone", r"\+49 \(0\)[1-9]\d \d{6}"),
    ("+49 30 1234567", "phone", r"\+49 [1-9]\d \d{7}"),
    ("+44 20 7946 0958", "phone", r"\+44 [1-9]\d \d{4} \d{4}"),
    ("+493012345678", "phone", r"\+\d{12}"),
    ("030 1234567", "phone", r"0[1-9]\d \d{7}"),
    ("(030) 1234567", "phone", r"\(0[1-9]\d\) \d{7}"),
    ("0171/12345678", "phone", r"0[1-9]\d\d/\d{8}"),
    ("01 23 45 67 89", "phone", r"0[1-9](?: \d\d){4}"),
    ("612 34 56 78", "phone", r"[2-9]\d\d(?: \d\d){3}"),
    ("663 555 6869", "phone", r"[2-9]\d\d [2-9]\d\d \d{4}"),
    ("DE89 3704 0044 0532 0130 00", "iban", r"DE\d\d(?: \d{4}){4} \d\d"),
    ("DE89370400440532013000", "iban", r"DE\d{20}"),
    ("GB29NWBK60161331926819", "iban", r"GB\d\d[A-Z]{4}\d{14}"),
    ("FR14 2004 1010 0505 0001 3M02 606", "iban", r"FR\d\d(?: \d{4}){4} \d[A-Z]\d\d \d{3}"),
    ("BE68 5390 0754 7034", "iban", r"BE\d\d(?: \d{4}){3}"),
    ("ES91 2100 0418 4502 0005 1332", "iban", r"ES\d\d(?: \d{4}){5}"),
    ("03/25/1984", "date_slash", r"\d\d/(?:1[3-9]|2\d|3[01])/\d{4}"),
    ("3/25/1984", "date_slash", r"\d\d?/(?:1[3-9]|2\d|3[01])/\d{4}"),
    ("3/5/1984", "date_slash", r"[1-9]\d?/[1-9]\d?/\d{4}"),
    ("1.2.1984", "date_dots", r"[1-9]\d?\.[1-9]\d?\.\d{4}"),
    ("1984-2-1", "date_iso", r"\d{4}-[1-9]\d?-[1-9]\d?"),
]
#: No valid values; what only looks like one of them stays.
UNUSUAL = ["DE88 3704 0044 0532 0130 00", "XX89370400440532013000", "02/30/1984", "13/13/1984", "31.2.1984", "1984-2-30", "1.2.3", "612 345 678", "4111111111111112", "in 2024 12 34"]


def test_usual_forms_of_personal_values(spark):
    texts = [f"a {v} BIC" for v, _, _ in USUAL] + [f"b ({v})." for v, _, _ in USUAL] + [f"c {v}, d" for v in UNUSUAL]
    got = rows_by_id(pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), DOCS), "k"))
    for i, (v, kind, form) in enumerate(USUAL):
        new = got[i]["text"].removeprefix("a ").removesuffix(" BIC")
        assert got[i]["kinds"] == {kind: 1} and new != v and re.fullmatch(form, new), (v, new)
        assert got[len(USUAL) + i]["text"] == f"b ({new})."
        assert kind != "iban" or mod97(v) == mod97(new) == 1
    for i, v in enumerate(UNUSUAL, 2 * len(USUAL)):
        assert got[i]["text"] == f"c {v}, d" and got[i]["n_values"] == 0, v


def test_month_first_dates_are_permuted_among_themselves(spark):
    days = spark.range(0, 72684).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("m"))
    got = days.select("m", pii._slash_date(F.col("m"), "k").alias("o")).collect()
    assert len(got) == 44028 and {r["o"] for r in got} == {r["m"] for r in got}


def plain_pseudonyms(text, key):
    """The kinds of KINDS one by one, as the docstrings tell, in plain Python; (text, values)."""
    import datetime

    import regex

    def fill(m, pattern, chars):
        chars = iter(chars)
        return re.sub(pattern, lambda _: next(chars), m)

    def char_radix(c):
        return (10, 48) if c.isdigit() else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (1, ord(c))

    def permuted(chars, tweak, shape=lambda c, i: char_radix(c)):
        shapes = [shape(c, i) for i, c in enumerate(chars)]
        got = plain_feistel([ord(c) - b for c, (_, b) in zip(chars, shapes)], [n for n, _ in shapes], key, tweak)
        return "".join(chr(v + b) for v, (_, b) in zip(got, shapes))

    def date(m, order, sep):
        parts = dict(zip(order, m.split(sep)))
        try:
            day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"]))
        except ValueError:
            return None
        first = datetime.date(1901, 1, 1)
        if not first <= day <= datetime.date(2099, 12, 31):
            return None
        n = (day - first).days
        a, b = plain_feistel([n // 673, n % 673], [108, 673], key, "date")
        new = first + datetime.timedelta(a * 673 + b)
        pad = "02d" if all(len(x) > 1 for x in parts.values()) else "d"
        return sep.join({"y": f"{new.year:04d}", "m": format(new.month, pad), "d": format(new.day, pad)}[o] for o in order)

    def one(m):
        if "@" in m:
            local, host = m.split("@")
            labels = host.split(".")
            if host.lower() not in pii.PROVIDERS.split():
                two = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2].lower() in pii.SECOND_LEVEL.split("|")
                suffix = labels[-2:] if two else labels[-1:]
                host = ".".join([permuted(".".join(labels[: -len(suffix)]), "host"), *suffix])
            return f"{permuted(local, 'email')}@{host}"
        digits = re.sub(r"\D", "", m)
        if regex.fullmatch(pii.KINDS[1].pattern, m, regex.A):
            code = re.match(r"(?:(?:\+|00)(?:1|33|34|49|44|[2-9]\d\d)(?:[ .-]?\(0\))?|\(?0)?", m)[0]
            rest = re.sub(r"\D", "", m[len(code) :])
            american = code in ("", "+1", "001") and len(rest) == 10

            def shape(c, i):
                lead = i == 0 or american and i == 3
                return (10, 48) if not lead else (8, 50) if c >= "2" else (2, 48) if american else (1, ord(c))

            return code + fill(m[len(code) :], r"\d", permuted(rest, "phone", shape))
        if re.fullmatch(r"[\d -]+", m) and 13 <= len(digits) <= 19:
            if luhn(digits) % 10:
                return None
            new = digits[0] + permuted(digits[1:-1], "card")
            return fill(m, r"\d", new + str(-luhn(new + "0") % 10))
        if re.match("[A-Z]{2}\\d\\d", m):
            if mod97(m) != 1:
                return None
            new = permuted(re.sub("[ -]", "", m[4:]), "iban")
            return fill(m, "[0-9A-Z]", m[:2] + f"{98 - mod97(m[:2] + '00' + new):02d}" + new)
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            area, group, serial = map(int, m.split("-"))
            a, g, r = plain_feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
            return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{r + 1:04d}"
        if re.fullmatch(r"(?:\d+\.){3}\d+", m):
            octets = list(map(int, m.split(".")))
            usual = 1 <= octets[0] <= 223
            got = plain_feistel([octets[0] - 1 if usual else 0, *octets[1:]], [223 if usual else 1, 256, 256, 256], key, "address")
            return ".".join(map(str, [got[0] + 1 if usual else octets[0], *got[1:]]))
        return date(m, "ymd", "-") if "-" in m else date(m, "dmy", ".") if "." in m else date(m, "dmy", "/")

    out, at, n = [], 0, 0
    for m in regex.finditer(pii.any_kind(), text, regex.A):
        new = one(m[0])
        n += new is not None
        out += [text[at : m.start()], m[0] if new is None else new]
        at = m.end()
    return "".join(out) + text[at:], n


def test_pseudonyms_are_the_plain_ones(spark, small, texts):
    got = rows_by_id(catalog.op1_pii(spark, small))
    changed = 0
    for i, t in texts.items():
        want, n = plain_pseudonyms(t, catalog.PII_KEY)
        changed += want != t
        assert (got[i]["text"], got[i]["n_values"]) == (want, n)
    assert changed > 5


# --- 2: decontamination --------------------------------------------------------------------------


def plain_hits(text, items, window):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    hit, found = set(), set()
    for k, t in items:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        n = min(window, len(w))
        if not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(k)
    return len(words), len(hit), sorted(found)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcx"), max_size=40), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_what_a_search_finds(items, doc, window):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    machine = decontaminate.SuffixAutomaton([(k, decontaminate.words_of(t)) for k, t in named], window)
    text = " ".join(doc)
    spans, found = machine.hits(decontaminate.words_of(text))
    assert (len(doc), sum(b - a for a, b in spans), sorted(found)) == plain_hits(text, named, window)
    gone = {i for a, b in spans for i in range(a, b)}
    assert decontaminate.cut(text, spans).split() == [w for i, w in enumerate(doc) if i not in gone]


def test_decontamination(spark, small, texts, edges, empty):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    got = rows_by_id(catalog.op2_decontaminate(spark, small))
    assert any(r["contaminated"] for r in got.values())
    for i, t in texts.items():
        n, hit, found = plain_hits(t, items, 10)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "lorem ipsum"), (4, "amet lorem"), (4, "amet lorem")], "item_id long, text string").withColumn("id", F.lit(0))
    out = [r for r in decontaminate.decontaminate(edges, odd).collect()]
    assert len(out) == len(EDGES) and all(r["n_hit"] == 0 for r in out if r["doc_id"] != 7)
    assert next(r for r in out if r["doc_id"] == 7)["items"] == ["4"]
    assert decontaminate.decontaminate(edges, odd.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, odd).count() == 0


def test_a_benchmark_larger_than_the_documents(spark, small, monkeypatch):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs, bench = texts.where("doc_id % 10 = 0"), texts.select(F.col("doc_id").alias("item_id"), "text")
    rows = lambda df: sorted(map(tuple, df.drop("coverage").collect()), key=repr)
    want = rows(decontaminate.decontaminate(docs, bench)), rows(decontaminate.decontaminated_documents(docs, bench.where("item_id < 50")))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30_000)
    assert (rows(decontaminate.decontaminate(docs, bench)), rows(decontaminate.decontaminated_documents(docs, bench.where("item_id < 50")))) == want
    monkeypatch.setattr(decontaminate, "SCANNED_BYTES", 1000)
    assert rows(decontaminate.decontaminate(docs.limit(0), bench)) == []


@pytest.mark.parametrize("block", [40, 300, 1 << 20])
def test_items_without_ids_and_in_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(block)

    def run(n):
        return " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(n))

    named = [(f"i{i}", run(rnd.choice((3, 12, 30, 90)))) for i in range(12)] + [(None, run(25)), (None, run(4)), ("none", None)]
    long = named[-3][1].split()
    rows = [(i, f"{run(8)} {named[i % 14][1]} {run(rnd.randint(0, 40))} {' '.join(long[i : i + 10])} end") for i in range(40)] + [(None, long[0]), (None, " ".join(long)), (50, None), (51, ""), (52, "other words only")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(named, "item_id string, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    want = []
    for i, t in rows:
        n, hit, found = plain_hits(t, [("~" if k is None else k, x) for k, x in named], 10)
        want.append((i, n, hit, len(found), [k for k in found if k != "~"]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got), key=key) == sorted(want, key=key)
    assert any("~" in plain_hits(t, [("~", x) for k, x in named if k is None], 10)[2] for _, t in rows)
    clean = {r["doc_id"]: (r["clean_text"], r["dropped"]) for r in got if r["doc_id"] is not None}
    kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated_documents(docs, bench).where("doc_id is not null").collect()}
    assert kept == {i: t for i, (t, dropped) in clean.items() if not dropped}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# --- 3: token counts -----------------------------------------------------------------------------

ODD = "abcdeſ'strem  \n\t<|endoftext|>ÀéΣςİßﬁ́你🎉0٣५.,!—…  \u0085\x1c_ª²​　"


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD if k % 2 else ODD[:22]) if rnd.random() < 0.95 else "<|endoftext|>" for _ in range(rnd.randint(0, 25))) for k in range(n)] + ["", "\n", " ", "a\n", " a", "a "]


def test_token_counts_are_the_librarys(spark, small, texts, edges, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = rows_by_id(catalog.op3_token_counts(spark, small))
    for i, t in texts.items():
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), size(t), size(t) > 2048)
    c = token_counts.counter(P.path("word_bpe_49k.json"))
    odd = odd_texts(3000)
    assert c.column(pa.array(odd, pa.large_string())).tolist() == [size(t) for t in odd]
    for t in odd[:500]:
        for chunk in (1, 3, 10, 1000):
            assert c.count(t.encode(), chunk) == size(t)
    out = token_counts.token_counts(edges, P.path("word_bpe_49k.json"), chunk_bytes=1000).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == sorted((i or 0, size(t)) for i, t in EDGES)
    assert token_counts.token_counts(empty, P.path("word_bpe_49k.json")).count() == 0


def test_long_texts_are_counted_by_state_maps(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    c = token_counts.Counter(P.path("word_bpe_49k.json"))
    rnd = random.Random(4)
    prose = " ".join(t for t in texts.values() if t)[:300_000]
    one_word = "".join(rnd.choice("etaoinshrdlué") for _ in range(200_000))
    for t in (prose, one_word, "a" * 100_001, "." * 5000 + one_word[:5000] + "<|endoftext|>" * 3 + prose[:5000], "x " * 40_000):
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert {c.count(t.encode(), n) for n in (1000, 4096, 1 << 16)} == {want}
    text = (prose[:30_000] + one_word[:9000] + prose[:30_000]).encode()
    chunks = list(c.chunks(text, 1000))
    order = list(range(len(chunks)))
    rnd.shuffle(order)
    made = {}
    for i in order:  # each of its chunk alone, in any order, by a machine of its own
        made[i] = token_counts.Counter(P.path("word_bpe_49k.json")).chunk_map(chunks[i]) if i % 30 == 0 else c.chunk_map(chunks[i])
    maps = [made[i] for i in range(len(chunks))]
    assert maps == [c.chunk_map(x) for x in chunks] and any(not m.ended for m in maps) and any(m.head for m in maps)
    while len(maps) > 1:  # and composed in any order of neighbours
        i = rnd.randrange(len(maps) - 1)
        maps[i : i + 2] = [c.compose(maps[i], maps[i + 1])]
    assert c.apply(maps[0], token_counts.START) == (token_counts.START, len(library.encode(text.decode(), add_special_tokens=False).ids))
    # a map holds for every state that it may be entered in
    head = token_counts.ChunkMap(b"ing", True, 5)
    for before in (b"runn", b"s", b"", b"xqz"):
        state, n = c.machine.run(token_counts.START, before, False)
        assert n + c.apply(head, state)[1] == c.machine.count(before + b"ing") + 5
    small_memory = token_counts.Counter(P.path("word_bpe_49k.json"))
    small_memory.machine.limit = 50
    assert small_memory.count(one_word[:20_000].encode(), 700) == c.count(one_word[:20_000].encode(), 4096)


@given(st.lists(st.text(alphabet="ab ", max_size=4), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_scan_is_the_running_composition(parts):
    want, acc = [], ""
    for p in parts:
        want.append(acc := acc + p)
    assert token_counts.scan(parts, lambda a, b: a + b) == want


# --- 4: chat formatting --------------------------------------------------------------------------


def test_chats_round_trip(spark, small):
    rows = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in catalog.op4_chat_format(spark, small).collect()}
    assert got.keys() == rows.keys()
    for k, turns in rows.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chats_of_edges(spark):
    nasty = ["</s>", "<\\/s>", "<\\\\/s>[INST]", "[\\INST]x[/INST]", "<", "/s>", "\\", "$1", ""]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)] + [(2, 0, "user", None), (2, None, None, "x"), (None, 0, "assistant", "a"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [x["text"] for x in out[1]["back"]] == nasty
    assert [x["role"] for x in out[2]["back"]] == ["", "user"] and out[2]["n_turns"] == 2
    assert not out[1]["valid"] and out[4]["valid"] and not out[None]["valid"] and out[None]["first_error"] == 0 and out[3]["first_error"] == 1
    assert out[4]["segments"][-2]["loss"] and not out[4]["segments"][1]["loss"]
    assert out[1]["formatted"].count("</s>") == len(nasty)
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(open="[A", close="[A]").controls()


# --- 5: byte-level BPE ---------------------------------------------------------------------------


def test_bpe_is_tiktokens(spark, small, texts, edges, empty):
    import tiktoken

    at = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    own = byte_bpe.tokenizer(*at)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    raw = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    got = rows_by_id(catalog.op5_byte_bpe(spark, small))
    for i, t in texts.items():
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(raw(t)) // 4, hashlib.sha256(raw(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    odd = odd_texts(3000, 2) + [None]
    assert own.encode_column(pa.array(odd)) == [raw(t) for t in odd]
    out = byte_bpe.decode(byte_bpe.encode(edges, *at), *at).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in out) == sorted((i or 0, raw(t), (t or "").encode()) for i, t in EDGES)
    assert byte_bpe.encode(empty, *at).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    for n in (0, 1, 2, 7, 3000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = byte_bpe.PerfectHash(keys)
        assert sorted(h.find(k) for k in keys) == list(range(n))
        assert all(h.find(f"x{i}".encode()) == -1 for i in range(200))


def test_merging_is_the_plain_merging():
    own = byte_bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(3)
    for _ in range(300):
        raw = bytes(rnd.choice(b"abcinge \xc3\xa9\xff") for _ in range(rnd.randint(0, 30)))
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            r, i = min((own.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert own.merge(raw) == [own.ranks[p] for p in parts]


# --- 6: token files ------------------------------------------------------------------------------


@given(st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=700))
@settings(max_examples=150, deadline=None)
def test_words_of_ids_round_trip(ids):
    assert packing.unpack(packing.pack(np.array(ids, np.uint64))).tolist() == ids


def test_token_files(spark, small, texts, edges, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    got = rows_by_id(catalog.op6_token_files(spark, small))
    start = 0
    for i in sorted(texts):
        x = ids(texts[i])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    odd = odd_texts(3000, 4)
    assert list(packing.library(P.path("byte_bpe_50k.json"))(pa.array(odd))) == [np.array(ids(t)[:-1], "<u4").tobytes() for t in odd]
    out = sorted(packing.write_and_read(edges, str(tmp_path / "e"), P.path("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in out] == [i for i, _ in order]
    assert [bytes(r["ids"]) for r in out] == [np.array(ids(t), "<u4").tobytes() for _, t in order]
    assert packing.write_and_read(empty, str(tmp_path / "n"), P.path("byte_bpe_50k.json")).count() == 0


# --- 7: near duplicates --------------------------------------------------------------------------


def plain_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(words)])) if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates(spark, small, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in catalog.op7_near_dedup(spark, small).collect()}
    assert got == plain_components(texts.items(), 3, 85)


def test_near_duplicates_of_chains_and_close_misses(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows, n = [], 0
    for chain in range(6):  # neighbours are near, ends are not; some groups only just miss
        words = base[chain * 3 :] if chain % 2 else [f"c{chain}x{i}" for i in range(120)]
        for _ in range(10):
            rows.append((n, " ".join(words)))
            n += 1
            words = words[rnd.choice((2, 3, 5)) :] + [f"n{rnd.randrange(10**6)}" for _ in range(3)]
    rows += [(n + k, rows[k][1].upper()) for k in range(8)]
    rnd.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_components(rows, 3, 85)


def test_near_duplicates_of_edges(spark, edges, empty):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(edges).collect())
    want = plain_components([e for e in EDGES if e[0] is not None], 3, 85)
    assert got == sorted([(i, *want[i]) for i, _ in EDGES if i is not None] + [(0, 2, 0, True)])  # no component without an id
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("slice_bytes", [60_000, 32 << 20])
def test_near_copies_that_stay_apart(spark, monkeypatch, slice_bytes):
    """Clouds of separate near copies, settled where they are stored, by cloud, or in many rounds."""
    monkeypatch.setattr(near_dedup, "TILE", 16)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 3000)
    rnd = random.Random(9)
    rows = []
    for cloud in range(3):
        base = [f"{cloud}w{i}" for i in range(150)]
        for _ in range(20 + 60 * cloud):  # a few words in common places: rare enough to stay apart, not alone
            words = list(base)
            for at in rnd.sample(range(0, 150, 3), rnd.choice((3, 4, 5, 6))):
                words[at] = f"x{rnd.randrange(3)}"
            rows.append((len(rows), " ".join(words)))
    rnd.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), near_dedup.Settings(slice_bytes=slice_bytes)).collect()}
    want = plain_components(rows, 3, 85)
    assert got == want and len({c for _, c, _ in want.values()}) > 20


def test_shuffle_of_separate_near_copies_grows_with_them(spark):
    """Copies of one text that stay apart, in one cloud, whose sets don't travel with the tasks at once."""
    import time

    def written(n):
        rnd, base = random.Random(3), [f"w{i}" for i in range(150)]
        rows = []
        for i in range(n):
            words = list(base)
            for at in rnd.sample(range(0, 150, 3), 5):
                words[at] = f"x{rnd.randrange(30)}"
            rows.append((i, " ".join(words)))
        docs = spark.createDataFrame(rows, DOCS)
        shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
        time.sleep(1)
        before = shuffled()
        got = near_dedup.near_duplicates(docs, near_dedup.Settings(slice_bytes=200_000)).agg(F.count("*"), F.count_distinct("component_id")).first()
        time.sleep(1)
        assert got[0] == n and got[1] > n // 4, got
        return shuffled() - before

    few, many = written(300), written(1200)
    assert 0 < many < 5 * few, (few, many)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = lambda k, n=40: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(1, text("a")), (3, text("a")), (3, text("b")), (4, text("b") + " more"), (5, text("c")), (5, text("c")), (6, text("d")), (6, text("e")), (7, text("e")), (None, text("a")), (None, text("f")), (8, text("f")), (9, text("g")), (9, text("h")), (9, text("i")), (2, text("i")), (10, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    root = {1: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 2, 2: 2, 10: 10}
    assert sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == sorted((i or 0, max(len(t.split()) - 2, 0), root.get(i, 0), i is None or root[i] == i) for i, t in rows)


def test_signatures_are_the_plain_ones(monkeypatch):
    def plain(hs, m, seed):
        out = [2**64 - 1] * m
        for x in hs:
            p = list(range(m))
            for j in range(m):
                r = int(mix(np.array([x], np.uint64), seed * 1000 + j)[0])
                k = j + (r >> 40) % (m - j)
                p[j], p[k] = p[k], p[j]
                out[p[j]] = min(out[p[j]], (j << 54) | (r & ((1 << 54) - 1)))
        return out

    rng = np.random.default_rng(0)
    for few in (2, 10_000):
        monkeypatch.setattr(superminhash, "FEW", few)
        sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 40, 0)]
        owner = np.repeat(np.arange(4), [len(s) for s in sets])
        got = superminhash.signatures(owner, np.concatenate(sets), 4, 24, 1)
        assert [list(map(int, r)) for r in got] == [plain(s, 24, 1) for s in sets]


def test_components(spark):
    rnd = random.Random(2)
    links = [(a, a + 1) for a in range(300)] + [(rnd.randrange(400, 700), rnd.randrange(400, 700)) for _ in range(200)] + [(900, 900), (901, 900), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8: quality rules ----------------------------------------------------------------------------


#: Bytes below which a band holds, and its bounds; those of chunks.
BANDS = {64: (0, 2.5), 256: (0.75, 2.75), 512: (1.28, 3.25), 1024: (1.36, 3.25), 4096: (1.45, 3.5), 16384: (1.6, 4.0), 1 << 60: (1.6, 5.0)}


def plain_verdict(raw, base):
    import zstandard

    size = lambda x: len(zstandard.compress(x, 3))
    whole = len(raw) / size(raw) if raw else 0.0
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if len(chunks) > 1:
        chunks[-1] = raw[-4096:]
        ratios = [4096 / size(c) for c in chunks]
        fine = all(1.6 <= r <= 4.5 for r in ratios)
    else:
        ratios, fine = [whole], True
    low, high = BANDS[min(b for b in BANDS if b > len(raw))]
    return whole, min(ratios), max(ratios), base and fine and low <= whole <= high


def test_quality_counts(spark, small, texts, edges, empty):
    got = rows_by_id(catalog.op8_quality(spark, small))
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = list(zip(words, words[1:], words[2:]))
        many = Counter(windows)
        repeat = len({k for j, w in enumerate(windows) if many[w] > 1 for k in (j, j + 1, j + 2)})
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat)
        assert r["base_failed"] == (len(words) < 50 or 100 * repeat > 50 * len(words))
        assert (r["ratio"], r["chunk_low"], r["chunk_high"], r["kept"]) == plain_verdict(t.encode(), not r["base_failed"])
    out = quality.quality(edges).collect()
    assert len(out) == len(EDGES) and all(not r["kept"] for r in out)
    assert quality.quality(empty).count() == 0
    assert quality.kept_documents(edges).count() == 0


def test_compression_bands_reject_repeats_and_noise():
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choice(("an", "the", "ou", "ing", "er", "st")) for _ in range(rnd.randint(1, 4))) for _ in range(6000)).encode()
    assert quality.verdict(prose, quality.Bands(), packer)[3] == ""
    assert quality.verdict(b"again " * 3000, quality.Bands(), packer)[3] == "repetitive"
    assert quality.verdict(rnd.randbytes(3000), quality.Bands(), packer)[3] == "incompressible"
    assert quality.verdict(prose + b"x" * 4096 * 2, quality.Bands(), packer)[3] in ("repetitive", "repetitive_chunk")
    assert quality.verdict(prose * 1 + rnd.randbytes(9000), quality.Bands(), packer)[3] in ("incompressible_chunk",)


def test_bands_reject_text_noise_and_keep_prose(spark, texts):
    import base64
    import string

    import zstandard

    packer, bands, rnd = zstandard.ZstdCompressor(level=3), quality.Bands(), random.Random(2)

    def encoded(n):
        return base64.b64encode(rnd.randbytes(n))[:n]

    def words(alphabet):
        return lambda n: " ".join("".join(rnd.choices(alphabet, k=rnd.randint(2, 10))) for _ in range(n)).encode()[:n]

    alnum = string.ascii_letters + string.digits
    noise = {"base64": encoded, "base64 lines": lambda n: base64.encodebytes(rnd.randbytes(n))[:n], "alnum words": words(alnum), "printable words": words(alnum + string.punctuation)}
    for name, make in noise.items():
        for n in (256, 400, 511, 512, 700, 1023, 1024, 2000, 4095, 4096, 10_000, 40_000):
            assert quality.verdict(make(n), bands, packer)[3] == "incompressible", (name, n)
    prose = max(texts.values(), key=len).encode()
    long = (prose * (1 + 40_000 // len(prose)))[:40_960] if len(prose) < 40_960 else prose[:40_960]
    assert quality.verdict(long[:12_288], bands, packer)[3] == ""
    assert quality.verdict(long[:8192] + encoded(4096) + long[8192:], bands, packer)[3] == "incompressible_chunk"
    text = words(alnum + string.punctuation)(6000).decode()
    row = quality.quality(spark.createDataFrame([(1, text)], DOCS)).first()
    assert row["n_words"] >= 50 and not row["base_failed"] and row["reason"] == "incompressible" and not row["kept"]


def test_chunks_reach_the_end_of_the_text(texts):
    import base64

    import zstandard

    packer, bands, rnd = zstandard.ZstdCompressor(level=3), quality.Bands(), random.Random(3)
    prose = max(texts.values(), key=len).encode()[:8288]
    spam, noise = (b"spam offer click here " * 200)[:4000], base64.b64encode(rnd.randbytes(3000))
    assert len(prose) == 8288 and quality.verdict(prose, bands, packer)[3] == ""
    for text in (prose + spam, spam + prose):
        assert quality.verdict(text, bands, packer)[3] == "repetitive_chunk"
    for text in (prose + noise, noise + prose):
        assert quality.verdict(text, bands, packer)[3] == "incompressible_chunk"
    for n in (4096, 4097, 8191, 8192, 8193):
        part, want = prose[:n], [prose[i : i + 4096] for i in range(0, n - 4095, 4096)] + [prose[n - 4096 : n]]
        ratios = [quality.ratio(x, packer) for x in want] if n > 4096 else [quality.ratio(part, packer)]
        assert quality.verdict(part, bands, packer)[1:3] == (min(ratios), max(ratios))


def test_labelled_good_documents_stay(spark, small):
    got = rows_by_id(catalog.op8_quality(spark, small))
    good = [r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()]
    assert not [i for i in good if not got[i]["base_failed"] and not got[i]["kept"]]


# --- 9: substring dedup --------------------------------------------------------------------------


def plain_removed(rows, n):
    first, spots = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
            if first[tuple(w[k : k + n])] < i:
                spots.setdefault(i, set()).update(range(k, k + n))
    return spots


def test_substring_dedup(spark, small, texts):
    spots = plain_removed(texts.items(), 13)
    assert spots
    got = rows_by_id(catalog.op9_substring_dedup(spark, small))
    for i, t in texts.items():
        w = t.encode().split()
        kept = [x for k, x in enumerate(w) if k not in spots.get(i, ())]
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_substring_dedup_with_a_full_sketch_and_edges(spark, edges, empty):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    tiny = substring_dedup.Sketch(cells_log2=6, depth=2, shard_log2=3)
    got = rows_by_id(substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS), 5, tiny))
    spots = plain_removed(rows, 5)
    for i, t in rows:
        assert got[i]["kept_text"].split() == [x for k, x in enumerate(t.split()) if k not in spots.get(i, ())]
    out = sorted(((r["doc_id"] or 0), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(edges, 13, substring_dedup.Sketch(cells_log2=12, shard_log2=8)).collect())
    assert out == sorted((i or 0, len((t or "").split()), 0) for i, t in EDGES)
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("n", [1, 3, 13])
def test_substring_dedup_of_repeated_and_null_ids(spark, n):
    rnd = random.Random(n)
    words = lambda k: " ".join(rnd.choice("abcdef") for _ in range(k))
    shared = words(40)
    rows = [(rnd.choice([None, 1, 2, 3, 5, 5, 5]), rnd.choice([shared, "", None, f"{words(rnd.randint(0, 30))} {shared} {words(3)}", words(rnd.randint(0, 50))])) for _ in range(80)]
    firsts = {}
    windows = lambda w: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    for i, t in rows:
        for x in windows((t or "").split()) if i is not None else ():
            firsts[x] = min(i, firsts.get(x, i))
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k, x in enumerate(windows(w)) if i is not None and firsts[x] < i for j in range(n)}
        want.append((i or 0, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS), n, substring_dedup.Sketch(cells_log2=16, shard_log2=12)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(want)


# --- 10: secrets ---------------------------------------------------------------------------------

KINDS = {"assign": (r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}


def plain_secrets(text):
    out = []
    for rank, (kind, (pattern, ok)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if ok(m)]
    return [x[2] for x in sorted(out)]


NASTY = ["password: token: abcdefgh", "é🎉 TOKEN='abc123xyz' api-key=no api_key = \"kkkkkk\"", "AKIA" + "A" * 16 + "AKIA", "AKIAAKIAB", "0123456789abcdef" * 3 + " secret=" + "f" * 30, "secret=short", "ghp_" + "a" * 36, ""]


def test_secrets(spark, small, texts):
    got = rows_by_id(catalog.op10_secrets(spark, small))
    for i, t in texts.items():
        want = plain_secrets(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x.startswith(k + ":") for x in want) for k in KINDS)


def test_secret_ledger(spark, edges, empty):
    rows = spark.createDataFrame(list(enumerate(NASTY)) + [(0, "password = hunter2222")], "path long, text string")
    found, ledger = secrets.scan(rows)
    for r in found.where("path > 0").collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["rank"] < 3] == plain_secrets(NASTY[r["path"]])
    assert ledger.count() == len(NASTY) + 1 and found.count() == len(NASTY) + 1
    more = rows.unionByName(spark.createDataFrame([(99, NASTY[0]), (98, "secret: brandnew1")], "path long, text string"))
    again, new = secrets.scan(more, ledger)
    assert new.count() == 1 and again.where("path = 98 and size(spans) = 1").count() == 1
    assert {r["path"]: r["spans"] for r in again.where("path in (99, 1)").collect()}[99] == []
    assert secrets.scan(more, ledger, rule_version="2")[1].count() == len(NASTY) + 2
    out = secrets.scan(edges.drop("path").withColumnRenamed("doc_id", "path"))[0]
    assert out.count() == len(EDGES)
    assert secrets.scan(empty.withColumnRenamed("doc_id", "path"))[0].count() == 0


# --- SQL ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_are_their_sql(name, spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())


def test_patterns_that_join_words_take_whole_texts():
    ranks = {bytes([b]): b for b in range(256)} | {b"a b": 256, b"a\nb": 257, b" b": 258}
    for pattern in (r"(?s).+", r"\w+|\W+", P.PATTERN):
        own = byte_bpe.ByteBPE(ranks, pattern)
        texts = ["a b", "a\nb", "ab a b\na b", ""]
        assert own.encode_column(pa.array(texts)) == [own.encode(t) for t in texts]
    assert byte_bpe.ByteBPE(ranks, P.PATTERN).pieces and not byte_bpe.ByteBPE(ranks, r"(?s).+").pieces


def test_hashes_are_compared_in_both_parts():
    known = pa.array([{"h": -1, "g": 5}, {"h": 7, "g": -2}, {"h": 7, "g": 3}], pa.struct([("h", pa.int64()), ("g", pa.int32())]))
    h, g = np.array([2**64 - 1, 2**64 - 1, 7, 7, 7, 8], np.uint64), np.array([5, 6, 2**32 - 2, 3, 4, 3], np.uint32)
    assert substring_dedup._among(h, g, known).tolist() == [True, False, True, True, False, False]
    assert substring_dedup._among(h, g, known.slice(0, 2)).tolist() == [True, False, True, False, False, False]
    assert not substring_dedup._among(h, g, known.slice(0, 0)).any()


def test_ledgers_are_committed_by_scan(spark, tmp_path):
    import os

    ledger = secrets.Ledger(spark, f"file://{tmp_path}/l")
    rows = lambda *x: spark.createDataFrame(x, "path long, text string")
    assert ledger.read().count() == 0
    one = ledger.scan(rows((1, "password: abcdef1"), (2, None), (3, "password: abcdef1")))
    assert sorted((r["path"], len(r["spans"])) for r in one.collect()) == [(1, 1), (2, 0), (3, 1)] and ledger.read().count() == 2
    two = ledger.scan(rows((9, "password: abcdef1"), (4, "secret=xyzxyz9")))
    assert sorted((r["path"], len(r["spans"])) for r in two.collect()) == [(4, 1), (9, 1)] and ledger.read().count() == 3
    written = [spark.read.parquet(p).count() for p in ledger._parts()]
    assert sorted(written) == [1, 2]  # only what was unseen
    os.remove(f"{ledger._parts()[0].removeprefix('file://')}/_SUCCESS")  # a scan that never ended
    assert ledger.read().count() in (1, 2)
    assert ledger.scan(rows((5, "")), rule_version="2").count() == 1 and ledger.scan(rows()).count() == 0
