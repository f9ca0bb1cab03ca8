"""Cleaning and packing of a corpus: toxic documents go, one document of each group of near copies stays, long repeats are
cut, documents with benchmark passages go, and what is left is packed into sequences.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Between stages the rows are written as Parquet in the shared folder that spark.checkpoint.dir names
and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.session import scratch, share_code
from tidemark.llm.decontamination import clean
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.packing import pack
from tidemark.llm.queries import table, tokenizer, toxicity_model
from tidemark.llm.suffix_dedup import cut_repeats
from tidemark.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the input's own rows and the labels, as op2 does; drops what scores 0.7 or more."""
    return keep_clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share four fifths of their five-word shingles, directly or over others, the smallest id stays."""
    share_code(spark)
    return keep_one(docs, size=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    return pack(docs, tokenizer()).drop("closed_by")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: Training a classifier and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
