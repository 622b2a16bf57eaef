"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pointlake.llm import bpe_codec, compact_windows, fingerprints, lattice_lm, metric_join, quality_rules, simhash_pivot, slack_packing, token_store, url_markov

#: Fixed values: (verdict, host with path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules.score(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.spans(_documents(spark, sf_dir)).drop("text_key")


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    store = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return store.read(docs)


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivot.near_duplicates(_documents(spark, sf_dir))


def op9_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op10_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_lattice_lm, op3_compact_windows, op4_metric_join, op5_bpe_codec, op6_fingerprints, op7_token_store, op8_simhash_pivots, op9_url_markov, op10_slack_packing)
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
