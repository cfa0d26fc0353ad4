"""A training-data pipeline of the corpus operators: each stage's rows are written and
read again as the next one's documents.

Every stage works on all that its predecessor kept and, but for the last, returns the
columns of documents, whatever else these have. Documents go that score under 0.7 for
quality or 0.5 and over for toxicity (a score at the threshold counts as over it), that are
near copies of another (0.8 of their five-word shingles or more; of a class the smallest id
stays, of repeated rows one), or that hold a benchmark window. Null texts are scored as
empty ones, and null and empty texts are copies of each other; very long texts are scored,
compared and searched whole, and packed in pieces; documents without an id stay; an empty
table stays empty. The operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctuality.llm import decontam, packing, quality, similar, toxicity
from punctuality.llm.shared import discard, scratch, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cluster=packing.text_cluster())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The learned and the iterative stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            done = written(stage(spark, docs, sf_dir), name, keep=True)
        if name != STAGES[0][0]:
            discard(spark, docs)  # what the stage before wrote
        docs = done
    return docs
