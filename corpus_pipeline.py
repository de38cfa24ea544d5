"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basalt.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from basalt.llm._names import column, columns, free
from basalt.llm._scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not one of the known ones, or not clear, go."""
    found = language_id.identify(docs)
    rejected = Scratch(spark, "stage-language").table(found.where("not accepted and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand elsewhere leave the text; documents of which nothing else was left go."""
    removed, emptied = free(docs, "removed", "emptied")
    return line_dedup.dedup_lines(docs, removed=removed, emptied=emptied).where(~column(emptied)).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays."""
    found = near_dedup.near_duplicates(docs)
    gone = Scratch(spark, "stage-near").table(found.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, within its error budget, go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 4096 tokens. Workers share memory with other stages'."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, cache_words=250_000)


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark), ("packing", pack)]
#: No stage can be put as SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
