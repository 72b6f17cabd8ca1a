"""Documents to training tokens: five stages, each applied to all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet below the shared folder
and reads back as the next stage's documents.

1. toxicity: documents predicted toxic go.
2. near_duplicates: of each class of texts with a 5-word-shingle similarity of
   0.8 or more one row with the least doc_id stays.
3. decontamination: documents that share a window of 10 words with a benchmark
   item go.
4. secrets: found secrets are replaced by a mark; all documents stay.
5. tokens: doc_id, n_tokens, ids and digests of the ids and of the bytes that
   they decode to.

Toxic and contaminated rows go by their own text, whatever their id. Stages hand
texts to Python in batches of at most ``BATCH_BYTES``, whatever the texts'
lengths; the setting stays with the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumflow.llm import bpe, decontam, ngram_join, secret_scan, toxicity
from forumflow.llm.common import staged, table

BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.encode_decode(docs).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]

#: The stages use a learned model and byte-level BPE, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
