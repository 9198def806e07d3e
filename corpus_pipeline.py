"""The corpus pipeline: documents in, packed training sequences out. Its stages are written and read again one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import settle
from gleaner.llm.decontaminate import drop_leaks
from gleaner.llm.exact_dups import keep_first
from gleaner.llm.near_dups import keep_one_of_each
from gleaner.llm.packing import pack_documents
from gleaner.llm.quality import keep_good
from gleaner.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad or toxic go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their runs of five words, directly or over others, the smallest id stays."""
    return keep_one_of_each(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces with their sequences."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("best-fit packing", packing),
]
# Two stages need a trained model and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
