"""The corpus operators, each applied with production parameters to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportmill.llm import collocations, divergence, extraction, forest, language, lattice, mixing, packing, quality, sentencepieces, sharding, simhash, substring
from reportmill.llm.common import held_out, small_batches, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lattice.score(table(spark, sf_dir, "documents"), held_out("doc_id", 7))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring.removals(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 4)
    found = language.identify(docs, held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentencepieces.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_best_fit_packing, op2_lattice_scores, op3_quality_rules, op4_vector_near_dedup, op5_main_text, op6_substring_dedup, op7_source_mixing, op8_simhash_near_dedup, op9_language_id, op10_sharding,
             op11_phrase_collocations, op12_source_divergence, op13_sentencepiece)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express: hashes and models are tested against brute force instead."""
    return {"op3_quality_rules": quality.ORACLE_SQL, "op4_vector_near_dedup": forest.ORACLE_SQL, "op6_substring_dedup": substring.ORACLE_SQL, "op7_source_mixing": mixing.ORACLE_SQL, "op11_phrase_collocations": collocations.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
