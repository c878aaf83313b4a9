"""One thin query an operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return store.spread(found) if name in ("documents", "pages", "embeddings") else found


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import token_ids

    manifest = token_ids.write(_table(spark, sf_dir, "documents"), _word_bpe(), store.fresh(spark, "token-ids"))
    return token_ids.read(manifest, ids=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import pii

    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import bpe

    return bpe.encode_decode(_table(spark, sf_dir, "documents"), _word_bpe(), digests=True)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import language

    return language.identify(_table(spark, sf_dir, "pages"), language.fit(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import decontamination

    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import sharding

    rows = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), store.fresh(spark, "shards"))
    raw = F.encode(F.coalesce("record.text", F.lit("")), "UTF-8")
    return rows.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import secret_scan

    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"), forest)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_token_ids, op2_pii, op3_bpe, op4_language, op5_decontamination, op6_sharding, op7_toxicity, op8_secrets, op9_neardup, op10_nearest)
    import corpus_pipeline

    return {f.__name__: f for f in made} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL expresses none of these over whole tables in reasonable time; tests hold each against brute force."""
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
