"""From raw documents to packed sequences: quality filter, near-duplicates, repeated passages, packing.

Counted as part of the subpackage pointlake.llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pointlake.llm import compact_windows, quality_rules, simhash_pivot, slack_packing
from pointlake.llm.common import materialise

#: Pieces of text that a packing worker keeps encoded, to the end of its task: few, as workers of all stages stay in memory.
REMEMBERED = 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash_pivot.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has."""
    return compact_windows.cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return slack_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, remembered=REMEMBERED, keep=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn a model, hash and tokenize, which SQL can't; tests hold them against brute force.
ORACLE_SQL = None
