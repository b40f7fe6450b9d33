"""Connected components of an edge table, by alternating large and small stars.

The method of Kiveris et al. (2014). Every round groups by vertex with partial
aggregation and joins the result back. The aggregate is written first: with an exchange
right below either side of the join Spark can split the edges of a vertex of any degree
over tasks. Rounds are written to the shared folder, so a lost executor costs tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of u to the least vertex around u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the least of them; edges have u > v."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of edges (u, v) but the roots; root is the least vertex reachable."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        now = materialize(_small_star(materialize(_large_star(now), "cc-stars")), "cc")
        # a star forest is a fixed point; the sum of the edges' hashes tells whether the round changed anything
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
