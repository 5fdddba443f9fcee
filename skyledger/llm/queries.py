"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skyledger.llm import bpe, conversations, exact, fingerprints, language_model, lexical, mixing, near, repeats, shards, tokens, toxicity, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return language_model.score_against_target(_table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), url_rules.rules_frame(spark))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("evidence")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicate_groups(_table(spark, sf_dir, "documents"), near.Rule(size=2))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_runs(_table(spark, sf_dir, "documents"), least_line=repeats.LEAST_LINE)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversations.encoded_sequences(_table(spark, sf_dir, "conversations"))
    return conversations.prefix_trie(conversations.branched(own))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced_shards(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_lm_scoring, op4_token_counts, op5_mixing, op6_url_rules, op7_exact_dedup, op8_toxicity, op9_near_dedup, op10_substring_dedup, op11_lexical_search, op12_conversation_trie, op13_sharding, pipeline)}


def llm_oracle() -> dict[str, str]:
    return {"op6_url_rules": url_rules.ORACLE, "op7_exact_dedup": exact.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_conversation_trie": conversations.ORACLE}
