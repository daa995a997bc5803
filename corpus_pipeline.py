"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of documents, but for the last one, which returns the
placed pieces. Stages pass data on as tables, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import language, mixing, packing, simhash, substring
from reportmill.llm.common import held_out, small_batches
from reportmill.operators.shared import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null, without a letter or in no language the model knows go."""
    small_batches(spark)
    return language.keep_known(docs, held_out("doc_id", 4))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies, the one with the smallest id."""
    small_batches(spark)
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has; n_chars follows the text."""
    small_batches(spark)
    kept = substring.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place in it."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: Models and hashes are not SQL; the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
