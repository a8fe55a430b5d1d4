"""From raw documents to token ids, in stages. Each takes all that the one before kept.

What holds for all stages: an empty table gives an empty table; other columns may hold nulls and stay
as they are; repeated rows are separate rows but in near-duplicate removal, where rows of one
id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import byte_bpe, decontaminate, near_dedup, pii, quality
from postloom.llm.catalog import PII_KEY, table
from postloom.llm.common import scratch

#: What the stages do can't be said in SQL: compression, signatures, an automaton, permutations, merges.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; null ids stay."""
    return quality.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, 80 %. Documents without an id or without words stay."""
    gone = near_dedup.near_duplicates(docs, near_dedup.PROSE).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go. Null and empty texts and null ids stay."""
    return decontaminate.decontaminated_documents(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced within their formats. Null and empty texts and null ids stay."""
    return pii.pseudonymize_documents(docs, PII_KEY)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digests of the ids and of what they decode to. Null and empty texts have no ids; null doc_ids stay."""
    at = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_bpe.round_trip(docs, *at)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("personal data", pseudonyms),
    ("byte-level BPE", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
