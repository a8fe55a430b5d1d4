"""Divergence of sources, clusters and archives: against SQL, plain versions and edge cases."""

import base64
import glob
import gzip
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postloom.llm import catalog, clustering, divergence, warc
from postloom.llm.common import scratch


@pytest.mark.parametrize("name", ["op11_divergence", "op12_clusters", "op13_warc"])
def test_query_is_its_sql(name, spark, small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got and got == sorted(map(tuple, want.fetchall()), key=repr)


# --- divergence --------------------------------------------------------------------------------


def plain_divergence(rows, least, most):
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    docs = [([w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")], lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(w for ws, *_ in mine for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        by = defaultdict(Counter)
        for ws, _, s in mine:
            by[s].update(w for w in ws if w in set(kept))
        total = sum(by.values(), Counter())
        p = {s: [1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept] for s, c in by.items()}
        q = [1 + 10**9 * (total[w] + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept]
        for s in by:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in by if o != s)
            terms = sorted((b - a, w.encode(), w) for a, b, w in zip(p[s], q, kept) if by[s][w] and a > b)[:most]
            out |= {(lang, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found, 1)}
    return out


def divergence_rows():
    r = random.Random(4)
    words = ["alpha", "Beta", "été", "ÉTÉ", "γ", "x", "the", "don't", "a1b", "日本", "z" * 40]
    rows = [(" ".join(r.choices(words, weights=range(1, 12), k=r.randrange(30))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S2", "ß", "", None, "s9"])) for _ in range(300)]
    return rows + [(None, "de", "only"), ("", "de", "other"), ("rare words here", "es", "alone"), ("lorem ipsum dolor " * 20_000, "en", "s1")] + [("same the text", "en", "s1")] * 40


@pytest.mark.parametrize("sources, terms", [(256, 1024), (2, 3)])
def test_divergence_is_its_plain_version(spark, sources, terms):
    rows = divergence_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("block", F.lit(None).cast("int"))
    got = divergence.divergence(df.repartition(7), least_docs=20, most_terms=4, sources=sources, terms=terms)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_divergence(rows, 20, 4)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=5), st.integers(1, 10**6))
@settings(max_examples=60, deadline=None)
def test_shares_are_exact_where_a_product_would_overflow(counts, v):
    n = sum(counts)
    assert divergence.share(np.array(counts), np.array([n]), v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v) for c in counts]


def test_pair_sums_in_parts(monkeypatch):
    r = np.random.default_rng(1)
    a, b, times = r.integers(0, 10**9, (5, 7)), r.integers(0, 10**9, (4, 7)), r.integers(0, 3, 7)
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", 300)
    assert divergence.pair_sums(a, b, times).tolist() == [[sum(int(abs(x - y)) * int(t) for x, y, t in zip(p, q, times)) for q in b] for p in a]


# --- clusters ------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    """[(vec_id, cluster, distance)], centers of (vec_id, integers)."""
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centers = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for t in range(rounds + 1):
        at = [min(range(len(centers)), key=lambda j: (far(v, centers[j]), j)) for _, v in rows]
        if t < rounds:
            for j in range(len(centers)):
                mine = [v for (_, v), a in zip(rows, at) if a == j]
                if mine:
                    centers[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, a, far(v, centers[a])) for (i, v), a in zip(rows, at)), key=repr), centers


VECTORS = "vec_id long, embedding array<float>, cluster string, sums string"


@pytest.mark.parametrize("seed, n, spread", [(1, 300, 400), (2, 200, 2), (3, 5, 9), (4, 60, 90_000)])
def test_clusters_are_those_of_plain_rounds(spark, seed, n, spread):
    r = random.Random(seed)
    middles = [[r.randrange(-spread, spread) for _ in range(6)] for _ in range(5)]
    rows = [(i if i % 50 else None, [m + r.randrange(-2, 3) for m in r.choice(middles)]) for i in range(n)]
    rows += rows[:7] + [(3, rows[4][1])]
    bad = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 7), (5, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6, [float("nan")] * 6), (7, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, [x / 2 + 0.25 for x in v], "x", "y") for i, v in rows] + [(i, v, "x", "y") for i, v in bad], VECTORS)
    found = clustering.cluster_vectors(df.repartition(5), dims=6, scale=2)
    want, centers = plain_clusters(rows, 8, 10, 6)
    assert sorted((tuple(x) for x in found.assigned.collect()), key=repr) == want and found.centers == centers
    assert found.inertia == [sum(d for _, a, d in want if a == j) for j in range(len(centers))]
    assert found.scans[0] == len(rows) and len(found.scans) == 11
    if n == 300:
        assert sum(found.scans[5:]) < len(rows)  # bounds keep nearly all vectors unseen once centroids rest
    one = clustering.with_inertia(found).first()
    assert one["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[one["cluster"]])).encode()).hexdigest() and one["inertia"] == sum(found.inertia)


def test_clusters_of_nothing_and_of_huge_components(spark):
    empty = clustering.with_inertia(clustering.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="lie within"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))


@given(st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_bounds_never_change_an_assignment(seed):
    r = np.random.default_rng(seed)
    v = r.integers(-50, 50, (200, 3))
    centers = r.integers(-50, 50, (5, 3)).tolist()
    cluster, upper, lower = clustering.nearest(clustering.squared(v, np.array(centers)))
    for _ in range(6):
        before = centers
        centers = [[x + int(r.integers(-4, 5)) for x in c] for c in centers]
        cluster, upper, lower, _ = clustering.Bounds(centers, before).assign(v, cluster, upper, lower)
        d = clustering.squared(v, np.array(centers))
        assert cluster.tolist() == d.argmin(axis=1).tolist()
        own = np.sqrt(d[np.arange(200), cluster])
        d[np.arange(200), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1))).all()


# --- archives ------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, key string, file string"
ROWS = [(1, "http://a/x y\r\nz", "one"), (5, "http://b/é", "one"), (3, None, "one"), (4, "http://c", None), (9, "http://d", ""), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "n", "two"), (None, "n", "two"), (7, "q", "three"), (7, "q2", "three"), (2, "q3", "three"), (None, "q4", "three"), (8, "long", "<p>é🎉</p>" * 100_000)]


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def wanted(rows, least=0):
    most = {}
    for i, _, t in rows:
        if i is not None:
            most[t or ""] = max(i, most.get(t or "", i))
    out = []
    for i, _, t in rows:
        m = most.get(t or "")
        again = len((t or "").encode()) >= least and m is not None and m != i
        out.append((i, len((t or "").encode()), digest(t or ""), "revisit" if again else "response", m if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, file_bytes", [(0, 1 << 28), (1, 300), (4, 1)])
def test_archives_read_back(spark, least, file_bytes):
    at = scratch(spark, "warc")
    index = warc.write_warc(spark.createDataFrame([(*r, "k", "f") for r in ROWS], PAGES), at, least_bytes=least, file_bytes=file_bytes)
    back = warc.read_warc(index, at).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr) == wanted(ROWS, least)
    texts = {(i, digest(t or "")): (t or "").encode() for i, _, t in ROWS}
    assert all(r["payload"] == texts[r["page_id"], r["payload_digest"]] for r in back if r["record_type"] == "response") and all(r["payload"] is None for r in back if r["record_type"] == "revisit")
    assert {r["url"] for r in back if r["page_id"] == 1} == {"http://a/x%20y%0D%0Az"} and {r["url"] for r in back if r["page_id"] == 5} == {"http://b/é"}
    # any reader of gzip'd archives finds the same records
    folder = warc.place(f"{at}/archives")[1]
    whole = b"".join(gzip.open(f"{folder}/{n}").read() for n in sorted(os.listdir(folder)))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: re") == len(ROWS) and whole.count(b"WARC-Type: revisit") == sum(x[3] == "revisit" for x in wanted(ROWS, least))


def test_only_selected_records_are_read_and_damage_is_told(spark):
    at = scratch(spark, "warc")
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    index = warc.write_warc(spark.createDataFrame([(*r, "k", "f") for r in rows], PAGES).coalesce(1), at)
    chosen = index.where("page_id % 40 = 3")
    assert sorted(r["page_id"] for r in warc.read_warc(chosen, at, gap=0).collect()) == [3, 43, 83, 123, 163]
    assert sorted(r["page_id"] for r in warc.read_warc(chosen.unionByName(chosen.where("page_id = 3")), at).collect()) == [3, 3, 43, 83, 123, 163]
    assert warc.read_warc(index.where("page_id < 0"), at).collect() == []
    folder = warc.place(f"{at}/archives")[1]
    open(f"{folder}/left-by-a-lost-task.warc.gz", "wb").write(b"junk")
    assert warc.read_warc(index, at, with_payload=False).count() == 200
    hit = index.where("page_id = 43").first()
    raw = warc.record(43, "u", b"other", None, False, "d")[0].replace(b"other", b"0ther")
    with pytest.raises(ValueError, match="damaged payload"):
        warc.parse(raw)
    with pytest.raises(ValueError, match="damaged record"):
        warc.parse(raw[:-6])
    os.truncate(f"{folder}/{hit['file']}", hit["offset"] + 5)
    with pytest.raises(Exception, match="ends before"):
        warc.read_warc(index, at).collect()


def test_archive_of_nothing(spark):
    at = scratch(spark, "warc")
    index = warc.write_warc(spark.createDataFrame([], PAGES), at)
    assert index.collect() == [] and warc.read_warc(index, at).collect() == [] and warc.read_index(spark, at).columns == index.columns


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50), st.integers(1, 9)), max_size=20), st.integers(0, 5), st.integers(5, 30))
@settings(max_examples=80, deadline=None)
def test_ranges_hold_each_record_once(rows, gap, most):
    rows = sorted((f"f{a}", b, c) for a, b, c in rows)
    got = list(warc.ranges(iter(rows), gap, most))
    assert [(f, o, n) for f, _, _, held in got for o, n in held] == rows
    for _, begin, end, held in got:
        assert begin == held[0][0] and end == max(o + n for o, n in held) and end - begin <= max(most, *(n for _, n in held), 0)
