"""A training corpus from `documents`: toxicity, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. Rejected documents go,
secrets are blotted out, and the last stage returns each remaining document's
ids and the digest of their decoded form.

Defined results: documents with null or empty texts stay, as does a row without
key; rows that repeat are judged alike, and of rows that are one text the one of
the smallest key stays (all rows of that key, if it repeats). Texts of any length
are taken whole. An empty table gives no rows. All stages but the last return the
columns of `documents` and ignore others, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontamination, neardup, secret_scan, store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return neardup.without_duplicates(docs, size=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark."""
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.redacted(docs, forest).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids as little-endian unsigned 32-bit integers, and what they decode to."""
    import public_tokenizers

    made = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("lang", "source"))
    return made.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", blot_secrets),
    ("bpe", token_ids),
]

#: SQL can express neither the learned stages nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with store.small_batches(spark, 500, 1):  # workers live through all stages
        for name, stage in STAGES:
            docs = store.kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
