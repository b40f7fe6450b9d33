"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it kept.

All but the last return the columns of docs, whatever further ones there are. Every
stage decides by each row's own text: rows with a null doc_id and rows that share one
are treated like any other, unless said otherwise. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.session import ship

from . import decontamination, packing, quality_fm, simhash, substring_dedup, tokens
from .common import doc_crc

#: Documents that score below this go.
QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the labels outside the held-out quarter.

    Null text is scored as the empty text; repeated rows get the same verdict each.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_fm.fit(quality_fm.labelled_sample(docs, labels, doc_crc() % 4 != 2))
    return quality_fm.filter_rows(docs, machine, QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8.

    The least doc_id stays; a null doc_id only where the group has no other; null and
    wordless texts form one group; wholly equal rows count once.
    """
    ship(spark)
    return simhash.keep_similar(docs, similarity=0.8, words=5)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of 50 words and more out of all documents but the first.

    Null texts stay null; rows with a null doc_id lose nothing and cost no other row anything;
    rows that share a doc_id cost one another nothing; a document may become empty.
    """
    ship(spark)
    return substring_dedup.dedup_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, each row by its own text; null and wordless texts stay."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8, recall=0.99)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 4096; null text is the end token alone, repeated rows are packed each for itself."""
    ship(spark)
    return packing.pack(packing.pieces(docs, tokens.default_path(), capacity=4096, end_id=1), capacity=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", best_fit_packing),
]
