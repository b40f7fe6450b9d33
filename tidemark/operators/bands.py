"""Band joins: equal keys and a difference of two numbers between two bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: float, high: float, width: float | None = None) -> DataFrame:
    """Pairs of equal keys with low <= left.at - right.at <= high.

    The number line is cut into intervals of one width. A row of right is in one of them;
    a row of left is sent to those that its band meets, two or three at the default width.
    The join is an equi-join on keys and interval, and the bounds are tested again, so
    each pair comes once, whatever the width. A smaller width deals a hot key over more
    tasks, a larger one sends fewer rows. Null keys and null numbers match nothing;
    columns of right but the keys get the prefix ``r_``.
    """
    if high < low:
        raise ValueError("high is below low")
    width = width or max(high - low, 1)
    slot = lambda c: F.floor(c / F.lit(float(width)))
    slots = F.sequence(slot(F.col(at) - F.lit(high)), slot(F.col(at) - F.lit(low)))
    a = left.filter(F.col(at).isNotNull()).withColumn("_slot", F.explode(slots))
    b = right.filter(F.col(at).isNotNull()).select(*keys, slot(F.col(at)).alias("_slot"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    return a.join(b, [*keys, "_slot"]).filter((F.col(at) - F.col(f"r_{at}")).between(low, high)).drop("_slot")


def band_aggregate(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: float, high: float, aggs: dict[str, Column], merge: dict[str, Column], width: float | None = None) -> DataFrame:
    """Aggregates of right's rows in the band before each distinct (keys, at) of left that has any.

    ``aggs`` fold right's rows of one place, ``merge`` folds those results over the band
    (columns are named ``r_`` and the name). Both sides have one row a place before they
    meet, so rows of a hot key that share a place cost one pair.
    """
    places = left.select(*keys, at).distinct()
    folded = right.groupBy(*keys, at).agg(*[c.alias(n) for n, c in aggs.items()])
    pairs = band_join(places, folded, keys, at, low, high, width)
    return pairs.groupBy(*keys, at).agg(*[c.alias(n) for n, c in merge.items()])
