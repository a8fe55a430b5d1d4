import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from postloom.llm import quality
from test_operators import plain_components, plain_hits


def test_stages_and_result(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen, small)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        before, after = {r["doc_id"]: r["text"] for r in seen.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() <= before.keys()
        if stage is corpus_pipeline.quality_rules:
            want = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
            assert after == {i: before[i] for i in want}
        if stage is corpus_pipeline.near_dedup_stage:
            groups = plain_components(before.items(), 5, 80)
            assert after == {i: before[i] for i, (_, root, _) in groups.items() if root == i} and len(after) < len(before)
        if stage is corpus_pipeline.decontamination:
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            for i, t in before.items():
                n, hit, _ = plain_hits(t, items, 10)
                assert (i not in after) if hit and hit >= 0.5 * n else after[i] == t if not hit else plain_hits(after[i], items, 10)[1] == 0
        seen = spark.createDataFrame(out.collect(), out.schema)
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    import public_tokenizers
    from postloom.llm import byte_bpe

    t = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in last.values():
        assert len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(next(iter(t.decode([bytes(r["ids"])])))).hexdigest() == r["decoded_sha256"]
    assert {i: r["decoded_sha256"] for i, r in last.items()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in seen.collect()}


def test_stages_take_nulls_and_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (None, "word " * 60, None, None, 300), (2, " ".join(f"w{i}" for i in range(80)), "en", None, None), (2, " ".join(f"w{i}" for i in range(80)), "en", None, None)]
    odd = spark.createDataFrame(rows, docs.schema).withColumn("h", F.lit(None).cast("string"))
    prose = " ".join(f"w{i}" for i in range(80))
    # by stage: the ids and texts that stay
    everything = [(i, t) for i, t, *_ in rows]
    want = [[(2, prose), (2, prose)], everything, everything, everything, [(i, None) for i, _ in everything]]
    by = lambda x: sorted(x, key=lambda r: (r[0] or 0, r[1] or ""))
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, odd, small)
        got = out.collect()
        assert by([(r["doc_id"], r["text"] if "text" in out.columns else None) for r in got]) == by(kept), name
        if "text" in out.columns:
            assert out.columns == odd.columns, name
        else:
            assert sorted(r["n_tokens"] == 0 for r in got) == [False, False, False, True, True]
        assert stage(spark, odd.limit(0), small).collect() == [], name
