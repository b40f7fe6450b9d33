"""A training-corpus pipeline: quality, near copies, repeated spans, leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of documents; the last returns the packed
pieces. run() writes every stage's result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize
from tidemark.llm.stages import STAGES

#: Trained models, iterated components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
