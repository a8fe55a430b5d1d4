"""What held queries back on larger tables."""

import datetime
import os
import random
import tracemalloc
from collections import Counter

import __spark_entry__
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.functions.text import tokenize
from postloom.operators import ann, graph, ingest, keyword, retrieval, search
from postloom.plans import data, feeds
from postloom.sources import accounts
from postloom.streaming import stateful
from tests.test_streams import Handle


@pytest.fixture
def few_recursive_rows(spark):
    """The limit of recursive SQL, made small."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_trees_of_folders_have_any_size(spark, tmp_path, few_recursive_rows):
    folders = spark.range(1, 40).selectExpr("id", "CASE WHEN id > 3 THEN id div 4 END AS parent", "'F' || (id % 5) AS name")
    lost = spark.createDataFrame([(90, 91, "x"), (91, 90, "x"), (92, 1000, "x")], "id long, parent long, name string")
    every = folders.unionByName(lost)
    parent = {i: i // 4 for i in range(4, 40)}
    steps = lambda i: [*(steps(parent[i]) if i in parent else []), f"F{i % 5}"]
    assert sorted(map(tuple, accounts.folder_paths(every, f"{tmp_path}/a").collect())) == [(i, "/".join(steps(i)), len(steps(i))) for i in range(1, 40)]
    wanted = spark.createDataFrame([("f2",), ("F3",), ("F3",), ("none",)], "name string")
    first = {n: min((steps(i), i) for i in range(1, 40) if i % 5 == n) for n in (2, 3)}
    assert sorted(map(tuple, accounts.find_folders(every, wanted, f"{tmp_path}/b").collect())) == [("F3", first[3][1], "/".join(first[3][0])), ("f2", first[2][1], "/".join(first[2][0]))]


def test_a_folder_below_itself_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (1, 1, "b")], "id long, parent long, name string")
    with pytest.raises(ValueError):
        accounts.folder_paths(rows, str(tmp_path))


def test_all_cells_hand_on_the_best_of_each_meeting_only(spark, tmp_path, monkeypatch):
    """Many copies, ids as text, and blocks smaller than the tables."""
    monkeypatch.setattr(ann, "EXACT_ROWS", 40)
    rng = np.random.default_rng(3)
    made = rng.normal(size=(60, 5)).round(2)
    x = np.concatenate([made, made[:2].repeat(50, axis=0), np.zeros((1, 5))])
    v = spark.createDataFrame([(f"v{i:03}", r.tolist()) for i, r in enumerate(x)], "id string, embedding array<double>")
    index = ann.VectorIndex.fit(v, f"{tmp_path}/i", n_cells=5, code_bytes=2)
    asked = v.where("id < 'v061' or id >= 'v158'")
    found = index.search_all(asked, 7)
    unit = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    near = lambda i: sorted((-float(np.floor(unit[i] @ u * 1e6 + 0.5)), f"v{j:03}") for j, u in enumerate(unit))[:7]
    want = [(f"v{i:03}", id, p) for i in [*range(61), 158, 159] for p, (_, id) in enumerate(near(i), 1)]
    assert [tuple(r) for r in found.orderBy("query_id", "place").select("query_id", "id", "place").collect()] == want
    assert found.agg(F.max("relevance")).first()[0] == 1.0
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in joins and "BroadcastHashJoin" not in joins  # no pair is joined to its vectors


@pytest.mark.parametrize("name", ["edges_person_person", "edges_person_topic"])
def test_edges_name_their_threads(spark, small, name):
    rows = __spark_entry__.queries()[name](spark, small).collect()
    threads = [set(r["thread_ids"].split(",")) - {""} for r in rows]
    assert any(threads) and [len(t) for t in threads] == [r["weight" if name == "edges_person_person" else "threads"] for r in rows]


def test_edges_count_quotes_of_whole_texts(spark, tmp_path):
    """Two threads: the '>' of the first comes after 5,000 characters and in an answer behind them, the second has none."""
    import duckdb

    long, at = "word " * 1000, f"{tmp_path}/conversations.parquet"
    turns = [(1, 0, "user", f"{long}> old text"), (1, 1, "assistant", long), (2, 0, "user", long), (2, 2, "assistant", long)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(at)
    got = __spark_entry__.queries()["edges_person_person"](spark, str(tmp_path))
    assert sorted(r["quotes"] for r in got.collect()) == [0, 2]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["edges_person_person"])
    assert sorted(map(tuple, got.select(*[d[0] for d in want.description]).collect())) == sorted(want.fetchall())
    m = spark.createDataFrame([("t", f"p{i}@x", f"m{i}", "", False, "." * 10**i + ">") for i in range(6)], "conversation_id string, sender string, message_id string, email_type string, is_replied boolean, document string")
    assert {r["quotes"] for r in graph.person_pairs(m).collect()} == {6}


@pytest.mark.parametrize("name", ["bm25_term_stats", "bm25_incremental"])
def test_each_term_has_its_statistics(spark, small, name):
    rows = {r["term"]: r for r in __spark_entry__.queries()[name](spark, small).collect()}
    words = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.explode(tokenize(F.col("text"))).alias("term"))
    want = words.groupBy("term").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("tokens")).collect()
    assert {t: (r["df"], r["tokens"]) for t, r in rows.items()} == {w["term"]: (w["df"], w["tokens"]) for w in want}


def test_an_epoch_is_classified_as_by_keyed_state(spark, tmp_path):
    """Three runs of one checkpoint, against the processors that hold state by key. No state is held by key where whole epochs are joined."""
    rng, shape = random.Random(5), "message_id string, date timestamp_ntz, body string, is_read boolean, is_replied boolean, is_flagged boolean"
    some = lambda n: [(rng.choice(["", None, *(f"m{i}" for i in range(12))]), datetime.datetime(2024, 1, rng.randint(1, 28), i % 24, i // 24), rng.choice(["", "one text", "other text", *(f"text {i}" for i in range(9))]), rng.random() < 0.5, False, False) for i in range(n)]
    states: dict = {}
    want, out, at = [], f"{tmp_path}/out", f"{tmp_path}/at"
    for epoch in range(3):
        spark.createDataFrame(some(40), shape).coalesce(1).write.parquet(f"{tmp_path}/in/{epoch}")
        stateful.ingest_stream(spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), out, at)
        rows = ingest.with_keys(spark.read.schema(shape).parquet(f"{tmp_path}/in/{epoch}")).toPandas()
        rows["place"] = rows["date"].astype(str) + rows["message_id"].fillna("")
        for kind, key in ((stateful._ById, "mid_hash"), (stateful._ByBody, "body_hash")):
            given = []
            for value, part in rows.groupby(rows[key].fillna("none"), sort=False):
                if (kind, value) not in states:
                    states[kind, value] = kind(1)
                    states[kind, value].init(Handle())
                given += list(states[kind, value].handleInputRows((value,), iter([part]), None))
            rows = pd.concat(given)
        want += [(epoch, r["date"], r["status"]) for _, r in rows.iterrows()]
    got = spark.read.option("basePath", out).parquet(out)
    assert sorted((r["epoch"], r["date"], r["status"]) for r in got.collect()) == sorted(want)
    assert {s for _, _, s in want} == {"new", "changed", "duplicate"} and not os.path.exists(f"{at}/state")


def test_what_is_known_is_forgotten_and_a_repeated_epoch_knows_earlier_ones_only(spark, tmp_path):
    shape, day = "message_id string, date timestamp_ntz, body string, is_read boolean, is_replied boolean, is_flagged boolean", datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("m", day, "a text", True, False, False)], shape)
    known = lambda epoch: stateful._known(spark, str(tmp_path), epoch, rows.schema, 365)
    for epoch, age in ((0, 400), (1, 1)):
        stateful.classify_epoch(rows, *known(epoch)).withColumn("taken_at", F.expr(f"current_timestamp() - INTERVAL {age} DAYS")).write.partitionBy("status").parquet(f"{tmp_path}/epoch={epoch}")
    assert [[d.count() for d in known(e)] for e in (0, 1, 2)] == [[0, 0], [0, 0], [1, 1]]


def _peak(work):
    """MB that numpy held at once."""
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_nearest_cells_are_found_in_bounded_memory():
    rng = np.random.default_rng(1)
    x, book = rng.normal(size=(10_000, 8)), ann.Codebook(rng.normal(size=(2_000, 8)), np.zeros((1, 1, 1)))
    near, mb = _peak(lambda: book.cells(x, 3))
    far = ((x[:50, None, :] - book.centers[None]) ** 2).sum(axis=2)
    assert near.shape == (10_000, 3) and (near[:50] == far.argsort(axis=1)[:, :3]).all() and mb < 60
    assert book.cells(x[:0]).shape == (0, 1)


def test_terms_are_counted_in_bounded_memory():
    tokens = [[f"t{(i * j) % 50}" for j in range(100)] if i % 7 else None if i % 2 else [] for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "ts"]).slice(3)
    done, mb = _peak(lambda: sum((b.num_rows for b in keyword._counted(batch))))
    assert done == 9_997 and mb < 8
    rows = [r for b in keyword._counted(batch) for r in b.to_pylist()]
    assert [(r["doc_id"], r["doc_len"], dict(zip(r["terms"], r["tfs"]))) for r in rows] == [(i, len(t or []), dict(Counter(t or []))) for i, t in enumerate(tokens)][3:]


@pytest.mark.parametrize("name", ["inbox_summary", "task_counts"])
def test_what_looks_among_vectors_builds_no_keyword_index(spark, small, name, monkeypatch):
    def build(*_a, **_k):
        raise AssertionError("built")

    monkeypatch.setattr(data, "_MADE", {})
    monkeypatch.setattr(keyword.Index, "build", build)
    assert __spark_entry__.queries()[name](spark, small).count() > 0


def test_blocks_are_made_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    """Slots are whole, of about equal length, and their blocks are those of the postings, also where runs, batches and slots end apart."""
    monkeypatch.setattr(keyword, "RUN_ROWS", 20)
    r = random.Random(1)
    tokens = [[f"t{r.randrange(30)}" for _ in range(r.randrange(40))] for _ in range(103)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i:03}" for i in range(103)]), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "ts"])
    counted = [b for at in range(0, 103, 7) for b in keyword._counted(batch.slice(at, 7))]
    slotted = pa.Table.from_batches(keyword._runs(counted, 2, 100))
    assert sorted(slotted["doc_id"].to_pylist()) == [f"d{i:03}" for i in range(103)] and slotted["slot"].to_pylist() == sorted(slotted["slot"].to_pylist())
    assert max(Counter(slotted["slot"].to_pylist()).values()) == 4
    want = {}
    for row in slotted.to_pylist():
        for term, tf in zip(row["terms"], row["tfs"]):
            want.setdefault((term, row["slot"]), []).append((row["doc_id"], tf, row["doc_len"]))
    rows = [b for part in keyword._blocks(iter(slotted.to_batches(max_chunksize=9))) for b in part.to_pylist()]
    assert len(rows) == len(want)
    for b in rows:
        posts = [tuple(p.values()) for p in b["posts"]]
        assert sorted(posts) == sorted(want[b["term"], b["slot"]]) and b["n"] == len(posts)
        assert b["max_tf"] == max(p[1] for p in posts) and b["min_len"] == min(p[2] for p in posts)
    plans = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, *a, f=type(spark.range(0)).mapInArrow: plans.append(f(df, *a)) or plans[-1])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(tokens)], "doc_id long, text string")
    index = keyword.Index.build(docs, f"{tmp_path}/index")
    at = f"{tmp_path}/index/segments/{index.content['segments'][0]['name']}"
    made = [p for p in plans if "posts" in p.columns]
    assert len(made) == 1 and "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(f"{at}/blocks").agg(F.sum("n")).first()[0] == index.postings.count()


def test_texts_of_hits_are_read_without_a_shuffle(spark):
    docs = spark.range(5_000).select("id", F.concat(F.lit("text "), "id").alias("document")).repartition(4)
    hits = retrieval.held(spark.range(0, 5_000, 500).select("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        found = retrieval.documents_of(retrieval.Corpus(docs, None), hits)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and found.count() == 10


def test_a_span_is_dealt_to_as_many_files(spark, tmp_path):
    for n in (0, 1, 3, 500):
        rows = spark.range(n).select(F.concat(F.lit("m"), "id").alias("message_id"))
        feeds._written_as(rows, f"{tmp_path}/{n}", 4)
        sizes = [spark.read.schema(rows.schema).parquet(f).count() for f in spark.read.schema(rows.schema).parquet(f"{tmp_path}/{n}").inputFiles()]
        assert len(sizes) == 4 and sum(sizes) == n and (n < 500 or max(sizes) < 200)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_held_rows_are_known_to_be_few(spark):
    held = retrieval.held(spark.range(0, 5_000, 500).select("id", F.lit(None).cast("double").alias("score")))
    assert "LocalTableScan" in _plan(held) and held.schema.simpleString() == "struct<id:bigint,score:double>" and held.count() == 10
    assert "BroadcastHashJoin" in _plan(spark.range(5_000).join(held, "id"))


def test_several_questions_read_the_vectors_once(spark, monkeypatch):
    """Also with ties, a row without length, and another number of hits for each."""
    rng = np.random.default_rng(2)
    rows = [(i, r.tolist()) for i, r in enumerate(np.concatenate([rng.normal(size=(40, 4)).round(1), np.ones((9, 4)), np.zeros((1, 4))]))]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = [([1.0, 0.0, 0.5, 2.0], 5), ([1.0, 1.0, 1.0, 1.0], 12), ([-1.0, 2.0, 0.0, 0.0], 60)]
    want = [search.knn(vectors, *q).collect() for q in queries]
    asked = []
    monkeypatch.setattr(search, "knn", None)
    monkeypatch.setattr(search, "knn_each", lambda *a, f=search.knn_each: asked.append(a) or f(*a))
    got = retrieval.nearest(vectors, queries)
    assert [h.orderBy(F.desc("relevance"), "id").collect() for h in got] == want and len(want[2]) == 49 and len(asked) == 1


def test_vectors_of_messages_are_joined_in_many_tasks(spark, small):
    """The messages name few vectors, which lie in one file: sent to the vectors, all would meet in its task."""
    plan = _plan(data._message_vectors(spark.range(40).selectExpr("'m' || id AS message_id", "id AS conv_id", "0L AS turn"), spark, small))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_threads_are_taken_in_one_pass(spark):
    rows = [("a", "t"), ("b", "t"), ("c", ""), ("d", None), ("e", "u"), (None, ""), ("thread:t", "")]
    messages = spark.createDataFrame(rows, "message_id string, conversation_id string")
    hits = retrieval.held(messages.where("message_id in ('a', 'd', 'thread:t') or message_id is null"))
    taken = search.expand_threads(messages, hits)
    assert _plan(taken).count("Scan ExistingRDD") == 1
    assert sorted(r["message_id"] for r in taken.collect()) == ["a", "b", "d", "thread:t"]
