"""From raw documents to a training mix: the stages, and one call that applies them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, minhash, mixing, q_quality, quality, repeats
from rowloom.llm.common import text_batches
from rowloom.session import settle

THRESHOLD = 0.5
#: similarity of near-duplicates in per cent; the 85 of op4 is that query's own
NEAR_PERCENT = 80
#: repeated strings of so many bytes are looked for (the 400 of op1 is that query's own), and go if they touch so many
#: words; 51 words of the tables' prose take 250 bytes or more, those of other texts may take other parameters
REPEAT_BYTES, REPEAT_WORDS = 240, 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op6 does not reject; its labels are those of ``sf_dir``."""
    text_batches(spark)
    model = q_quality.fitted(spark, sf_dir)
    return docs.where(quality.score_column(F.col("text"), model) >= THRESHOLD)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, rows without an id last.

    Different texts under one id are different documents; of rows that repeat both, one stays.
    """
    return minhash.one_each(docs, percent=NEAR_PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur again anywhere."""
    return repeats.remove(docs, length=REPEAT_BYTES, least_words=REPEAT_WORDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that the mix takes words of."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot state the classifier; tests/llm compares the later stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
