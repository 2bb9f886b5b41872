"""Corpus pipeline: toxicity, quality rules, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of documents. Nulls, empty and very long texts, ties, repeated rows, an empty
table and further columns have the results that the operators' docstrings state; a stage that drops documents keeps the others' rows as they are. Three stages use operators
that SQL cannot express (a trained classifier, XXH64 balls, a tokenizer), so ``ORACLE_SQL`` is None and the
stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from matchspark.llm.common import read_table, stored
from matchspark.llm.queries import tokenizer_path


#: rows of one Arrow batch: a Python worker holds the texts of one batch, and the workers of all stages live in the same executors
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """The pipeline is an application and sets its session: batches are bounded however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # a smaller cache of words: the workers still hold what the stages before have cached
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), cached=100_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
