"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import ann, decontaminate, language_id, licenses, line_dedup, near_dedup, packing, pii, quality, token_shards

#: Stands for a secret that a deployment reads from its own key store.
PII_KEY = "pseudonym-key-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("n_replaced"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)[2]


def op4_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    out = quality.classify(_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op8_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (no markup or address: declared ``lang``, ``source`` as host) and pages (all evidence)."""
    docs = language_id.identify(_table(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    return docs.unionByName(language_id.identify_pages(_table(spark, sf_dir, "pages")), allowMissingColumns=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


ALL = (op1_pii_pseudonyms, op2_license_scan, op3_token_shards, op4_ivfpq_search, op5_quality_classifier, op6_benchmark_leaks, op7_sequence_packing, op8_setsketch_dedup, op9_language_id, op10_line_dedup)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {}
