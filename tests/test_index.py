"""Stored indexes: keyword segments, blocks with bounds, product-quantized cells, and their manifests."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import ann, keyword
from postloom.operators.ann import VectorIndex
from postloom.operators.manifest import Conflict, Manifest

WORDS = [f"w{i}" for i in range(60)]


def docs_of(n, seed=1):
    r = random.Random(seed)
    return [(i, None if i % 97 == 5 else " ".join(r.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=r.choice([0, 3, 9, 40, 200])))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def content(index):
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    return rows(index.postings.select("doc_id", "term", "tf", "doc_len")), rows(index.terms.select("term", "df", "idf")), index.content["n"], index.content["tokens"]


def bytes_under(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_segments_and_tombstones_equal_an_index_made_anew(spark, tmp_path):
    rows = docs_of(300)
    index = keyword.Index.build(frame(spark, rows[:200]), f"{tmp_path}/a").add(frame(spark, rows[150:300]))
    assert content(index) == content(keyword.Index.build(frame(spark, rows), f"{tmp_path}/b"))
    assert [s["n"] for s in index.content["segments"]] == [200, 100]
    gone = frame(spark, [r for r in rows if r[0] % 3 == 0])
    left = [r for r in rows if r[0] % 3]
    removed, anew = index.remove(gone), keyword.Index.build(frame(spark, left), f"{tmp_path}/c")
    assert content(removed) == content(anew)
    back = removed.add(frame(spark, rows[:10]))  # a removed id may come back
    assert content(back) == content(keyword.Index.build(frame(spark, left + [r for r in rows[:10] if r[0] % 3 == 0]), f"{tmp_path}/d"))
    merged = back.compact(whole=True)
    assert content(merged) == content(back) and len(merged.content["segments"]) == 1 and not merged.content["deletes"]
    assert content(keyword.Index.load(spark, f"{tmp_path}/a")) == content(merged) and content(keyword.Index.load(spark, f"{tmp_path}/a", 0))[2] == 200
    question = "w0 w7 w7 w33"
    hits = lambda i: [tuple(r) for r in keyword.bm25(i, question, 12).collect()]
    assert hits(removed) == hits(anew) and hits(merged) == hits(back)
    assert index.remove(frame(spark, [(9999, "")])) is index and index.add(frame(spark, rows[:5])) is index


def test_compaction_by_size_keeps_tombstones_of_the_others(spark, tmp_path):
    rows = docs_of(90)
    index = keyword.Index.build(frame(spark, rows[:80]), f"{tmp_path}/a")
    for i in (80, 82, 84, 86):
        index = index.add(frame(spark, rows[i : i + 2]))
    index = index.remove(frame(spark, [rows[1], rows[81]]))
    merged = index.compact()
    assert sorted(s["n"] for s in merged.content["segments"]) == [7, 80] and sum(d["n"] for d in merged.content["deletes"]) == 1
    assert content(merged) == content(index)


def test_what_is_written_follows_what_is_added(spark, tmp_path):
    rows = docs_of(3000)
    index = keyword.Index.build(frame(spark, rows[:2970]).coalesce(2), f"{tmp_path}/a")
    before = bytes_under(f"{tmp_path}/a/segments")
    index.add(frame(spark, rows[2970:]).coalesce(1))
    assert bytes_under(f"{tmp_path}/a/segments") - before < 0.05 * before


def test_index_of_nothing(spark, tmp_path):
    index = keyword.Index.build(frame(spark, []), f"{tmp_path}/a")
    assert index.content["n"] == 0 and index.terms.count() == 0 and keyword.bm25(index, "w1", 3).collect() == []
    grown = index.add(frame(spark, [(1, "w1 w2"), (2, None), (3, "")]))
    assert content(grown)[2:] == (3, 2)


@pytest.fixture(scope="module")
def segmented(spark, tmp_path_factory):
    rows = docs_of(4000, 3)
    return keyword.Index.build(frame(spark, rows[:2500]), f"{tmp_path_factory.mktemp('index')}/a", slot_log2=4).add(frame(spark, rows[2500:])).remove(frame(spark, rows[::50]))


@pytest.mark.parametrize("question, n, share", [("w0", 5, 0.5), ("w3 w40", 7, 0.5), ("w0 w1 w2 w2 w50", 20, 1), ("w59 nothing", 400, 2)])
def test_bounds_lose_no_hit(spark, segmented, monkeypatch, question, n, share):
    """Against all postings scored; blocks whose bounds don't reach the last hit are never read."""
    monkeypatch.setattr(keyword, "FIRST_SLOTS", 4)
    monkeypatch.setattr(keyword, "SMALL_DOCS", 0)
    asked = keyword.search(segmented, question, n)
    best = lambda of: [tuple(r) for r in of.scored(of.blocks()).orderBy(F.desc("score"), "doc_id").limit(n).collect()]
    assert [tuple(r) for r in keyword.bm25(segmented, question, n).collect()] == best(asked)
    posts = lambda blocks: blocks.agg(F.sum("n")).first()[0] or 0
    first, _, rest = asked.passes()
    assert posts(asked.within(first)) + (posts(rest) if rest is not None else 0) < share * posts(asked.blocks())
    if n != 7:
        return
    some = spark.range(1, 4000, 7)
    assert [tuple(r) for r in keyword.bm25(segmented, question, n, some).collect()] == best(keyword.search(segmented, question, n, some))
    monkeypatch.setattr(keyword, "LISTED_SLOTS", 0)
    assert [tuple(r) for r in keyword.bm25(segmented, question, n).collect()] == best(asked)


def test_tokens_are_found_once(spark):
    plan = keyword.term_counts(frame(spark, docs_of(5)), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan


def test_of_two_writers_one_fails(spark, tmp_path):
    index = keyword.Index.build(frame(spark, docs_of(20)), f"{tmp_path}/a")
    index.add(frame(spark, [(100, "w1")]))
    with pytest.raises(Conflict):
        index.add(frame(spark, [(101, "w1")]))
    assert keyword.Index.load(spark, f"{tmp_path}/a").version == 1
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.read() == (-1, {}) and m.commit(-1, {"é": [1, None]}) == 0 and m.read() == (0, {"é": [1, None]})
    with pytest.raises(Conflict):
        m.commit(-1, {})
    assert m.commit(0, {}) == 1 and m.versions() == [0, 1] and not [n for n in os.listdir(f"{tmp_path}/m") if n.startswith(".") and not n.endswith(".crc")]


# --- vectors --------------------------------------------------------------------------------------


def test_codes_stand_for_the_nearest_words():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 10))
    centers = x[:6]
    home = ann.Codebook(centers, np.zeros((1, 1, 1))).cells(x)[:, 0]
    assert home.tolist() == ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1).tolist()
    book = ann.Codebook(centers, ann.codewords(x - centers[home], 4, r, most=32))
    assert book.words.shape == (4, 32, 3)  # ten places, padded to twelve
    codes = book.encode(x, home)
    made = np.concatenate([book.words[s][codes[:, s]] for s in range(4)], axis=1)[:, :10] + centers[home]
    other = np.concatenate([book.words[s][r.integers(0, 32, 500)] for s in range(4)], axis=1)[:, :10] + centers[home]
    assert ((x - made) ** 2).sum() < 0.5 * ((x - other) ** 2).sum()
    q = r.normal(size=(3, 10))
    for c in range(6):
        assert np.allclose(book.scores(q, book.tables(q), codes[home == c], c), q @ made[home == c].T)


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    """By scale: the test vectors and their index."""
    out = {}
    for size in ("0.001", "0.1"):
        v = spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
        out[size] = v, VectorIndex.fit(v, f"{tmp_path_factory.mktemp('cells')}/i")
    return out


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_cells_hold_most_of_the_nearest(spark, cells, size):
    """Recall against brute force of all ids divisible by 20, against all rows."""
    v, index = cells[size]
    assert index.vectors.count() == v.count() == index.codes.select(F.sum(F.size("ids"))).first()[0]
    assert index.codes.where(F.length("codes") != 16 * F.size("ids")).count() == 0  # sixteen bytes stand for a vector
    got = {}
    for r in VectorIndex.load(spark, index.path).search(v.where("id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    rows = v.collect()
    ids, m = np.array([r["id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        near = np.round(m @ m[i], 6)
        best = ids[np.lexsort((ids, -near))[:10]]
        found, total = found + len(set(best.tolist()) & got[int(ids[i])]), total + 10
    assert total and found >= 0.9 * total


def test_unwanted_cells_are_not_read(cells):
    v, index = cells["0.1"]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    wanted = index.wanted(v.where("id = 20")).first()["cells"]
    assert len(wanted) == index.probes and files(index.codes.where(F.col("cell").isin(wanted))) < 0.5 * files(index.codes)
    plan = index.search(v.where("id = 20"), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [cell") + plan.count("PartitionFilters: [isnotnull(cell") >= 2  # codes and vectors


def test_all_cells_give_exact_neighbours_also_of_text_ids_and_few_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(f"v{i}", [float(x) for x in r.integers(-3, 4, 5)]) for i in range(40)] + [("z", [0.0] * 5), ("n", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    index = VectorIndex.fit(v, f"{tmp_path}/i", n_cells=7, code_bytes=2)
    got = {}
    for x in index.search(v, 4, probes=7, shortlist=100).orderBy("query_id", "place").collect():
        got.setdefault(x["query_id"], []).append((x["id"], x["relevance"]))
    unit = {k: np.array(e) / np.linalg.norm(e) for k, e in rows if e and any(e)}
    for k, e in unit.items():
        want = sorted(((-round(float(e @ u), 6) + 0.0, j) for j, u in unit.items()))[:4]
        assert [s for _, s in got[k]] == [-s + 0.0 for s, _ in want]
    assert set(got) == set(unit)
