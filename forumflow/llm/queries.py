"""Registered queries of the operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumflow.llm import (ball_kmeans, bpe, decontam, ngram_join, ppm, prefix_trie, quality, secret_scan, sharding, token_counts,
                           token_files, topk, toxicity)
from forumflow.llm.common import table
from forumflow.llm.oracle import ORACLE


def q_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def q_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.derived_edits(table(spark, sf_dir, "documents"))
    return (token_counts.apply_edits(token_counts.build_trees(rows), keep_version=False)
            .select("doc_id", "n_before", "n_edits", F.col("n_tokens").alias("n_tokens"), "n_encoded"))


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def bpe_digest(docs: DataFrame) -> DataFrame:
    return bpe.encode_decode(docs).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def q_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def q_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.doc_findings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def q_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def q_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_documents(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def q_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": q_ngram_join,
    "op2_topk_search": q_topk_search,
    "op3_token_counts": q_token_counts,
    "op4_decontamination": q_decontamination,
    "op5_toxicity": q_toxicity,
    "op6_byte_bpe": q_bpe,
    "op7_secret_scan": q_secret_scan,
    "op8_lm_score": q_lm_score,
    "op9_token_files": q_token_files,
    "op10_sharding": q_sharding,
    "op11_conversation_trie": q_conversation_trie,
    "op12_quality": q_quality,
    "op13_vector_codes": q_vector_codes,
}

__all__ = ["ORACLE", "QUERIES", "bpe_digest"]
