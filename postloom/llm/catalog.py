"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import byte_bpe, chat, clustering, decontaminate, divergence, near_dedup, packing, pii, quality, secrets, substring_dedup, token_counts, warc
from postloom.llm.common import scratch
from postloom.llm.sql import SQL

#: Parameter of the pseudonyms; production runs pass their own secret.
PII_KEY = "postloom-example-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("doc_id", "text", "n_values", kinds.alias("kinds"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    template = chat.Template()
    out = chat.format_chats(chats, template)
    said = F.array_join(F.transform(chat.read_back(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"], template)), "")
    return out.withColumn("learnt", learnt).select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_bpe.round_trip(table(spark, sf_dir, "documents"), *at)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.write_and_read(table(spark, sf_dir, "documents"), scratch(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_low", "chunk_high", "reason")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in all documents by a ledger that has met those in other languages than English before."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", "lang")
    ledger = secrets.Ledger(spark, scratch(spark, "secrets"))
    ledger.scan(docs.where("lang <> 'en'"))
    found = ledger.scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    return found.select(F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(clustering.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "warc")
    index = warc.write_warc(table(spark, sf_dir, "pages"), at)
    return warc.read_warc(index, at, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_token_counts, op4_chat_format, op5_byte_bpe, op6_token_files, op7_near_dedup, op8_quality, op9_substring_dedup, op10_secrets, op11_divergence, op12_clusters, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
