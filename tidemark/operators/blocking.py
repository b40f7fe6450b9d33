"""Candidate pairs through shared keys, in place of cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(left: DataFrame, left_id: str, left_keys: Column, right: DataFrame, right_id: str, right_keys: Column, least: int = 1) -> DataFrame:
    """(left_id, right_id, shared): pairs that share at least ``least`` keys.

    Keys are exploded on both sides and joined; partial aggregation counts the
    shared keys before the shuffle.
    """
    a = left.select(left_id, F.explode(left_keys).alias("_key"))
    b = right.select(right_id, F.explode(right_keys).alias("_key"))
    return a.join(b, "_key").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def adaptive_cut(scored: DataFrame, key: str, score: str, order: list[Column], floor: float, share: float = 0.85, few: int = 3, many: int = 5) -> DataFrame:
    """Per key the rows of at least max(floor, share x best), at most ``many``; the best ``few`` where none reach it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    limit = F.greatest(F.lit(floor), share * F.max(score).over(w))
    ranked = scored.withColumn("_ok", F.col(score) >= limit).withColumn("_n", F.row_number().over(w.orderBy(F.desc(score), *order)))
    any_ok = F.max(F.col("_ok").cast("int")).over(w) == 1
    return ranked.withColumn("_any", any_ok).filter((F.col("_any") & F.col("_ok") & (F.col("_n") <= many)) | (~F.col("_any") & (F.col("_n") <= few))).drop("_ok", "_n", "_any")
