"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's rows as Parquet in the shared folder and reads
them back as the next stage's documents. All stages but the last return the
columns of ``documents``; the last returns the packed sequences.

Null texts, repeated rows, empty tables and extra columns are handled as the
operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermoload.llm import exact_dedup, mixture, ngram_join, packing, quality_rules
from thermoload.llm.common import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules accept."""
    return quality_rules.clean(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    return exact_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity of 0.75 or more, the one with the smallest id."""
    return ngram_join.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: a row per document and epoch with the words taken."""
    return mixture.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: bin, capacity, words, and the ids and texts of its pieces."""
    return packing.sequences(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixture", source_mix),
    ("best-fit packing", pack),
]

# Mixing draws at random and packing is a greedy search: not SQL. The stages are
# tested against brute force in tests/llm instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
