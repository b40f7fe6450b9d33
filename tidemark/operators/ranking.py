"""Positions, running sums, ranks, quantiles and ranking metrics without a window over a whole group.

A group may hold a large share of all rows. Rows are range-partitioned by group and
order, so a large group spans many partitions; a window runs inside one partition of
one group, and the totals of the partitions before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.allocation import cut_lineage


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds per group, in the given total order, the sum of each column so far, the row itself included.

    sums: the new columns and what they add up. Null values add nothing; rows whose
    keys are null form a group. Without keys all rows are one group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    # a partition with several groups has one row a group, a group in several partitions one row a partition
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_w{i}") for i, c in enumerate(sums.values())])
    out = [(F.col(f"_b{i}") + F.col(f"_w{i}")).alias(name) for i, name in enumerate(sums)]
    return within.join(bases, same).select(*df.columns, *out)


def _upto(df: DataFrame, keys: list[str], value: str, descending: bool = False) -> DataFrame:
    """(keys, value, _n, _upto): each distinct value's rows, and the rows up to it; a hot value is one row."""
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return running(per, keys, [F.desc(value) if descending else F.asc(value)], {"_upto": "_n"})


def with_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank by value, largest first; equal values share the least rank and null comes last."""
    ranks = _upto(df, keys, value, True).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    same = F.col(value).eqNullSafe(F.col("_v"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same).select(*df.columns, name)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, linear between neighbours; nulls do not count, groups without values are left out."""
    upto = _upto(df.filter(F.col(value).isNotNull()), keys, value)
    sizes = upto.groupBy(*keys).agg(F.max("_upto").alias("_all"))
    if keys:
        same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
        joined = upto.join(sizes.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "_all"), same)
    else:
        joined = upto.crossJoin(F.broadcast(sizes))  # one row
    at = lambda place: F.min(F.when(F.col("_upto") >= place + 1, F.col(value)))
    marks = []
    for i, p in enumerate(shares.values()):
        place = (F.col("_all") - 1) * F.lit(p)
        marks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    got = joined.groupBy(*keys).agg(*marks)
    return got.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(shares)])


def average_precision(df: DataFrame, key: str, order: list[Column], label: str) -> DataFrame:
    """(key, ap) of each group with a positive label: hits so far over position, averaged over the hits."""
    at = running(df.select("*", F.lit(1).alias("_one")), [key], order, {"_k": "_one", "_seen": label})
    return at.groupBy(key).agg((F.sum(F.when(F.col(label) == 1, F.col("_seen") / F.col("_k"))) / F.sum(label)).alias("ap"), F.sum(label).alias("_hits")).filter("_hits > 0").select(key, "ap")


def top_k(df: DataFrame, key: str, order: list[Column], label: str, k: int) -> DataFrame:
    """(key, p, r): precision and recall of each group's first k rows; recall is 0 where no label is positive."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= k)  # cut before the exchange
    hits = first.groupBy(key).agg(F.sum(label).alias("_hits"), F.count(F.lit(1)).alias("_taken"))
    whole = df.groupBy(key).agg(F.sum(label).alias("_all"))
    return whole.join(hits, key).select(key, (F.col("_hits") / F.col("_taken")).alias("p"), F.when(F.col("_all") == 0, 0.0).otherwise(F.col("_hits") / F.col("_all")).alias("r"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc,): rank-sum AUC; equal scores share their mean rank. Null where a class is missing."""
    per = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_pos"))
    r = running(per, [], [F.asc(score)], {"_upto": "_n"}).withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2)
    a = r.agg(F.sum(F.col("_rank") * F.col("_pos")).alias("s"), F.sum("_pos").alias("p"), F.sum("_n").alias("n"))
    return a.selectExpr("try_divide(s - p * (p + 1) / 2, p * (n - p)) as auc")
