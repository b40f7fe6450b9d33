"""Approximate quantiles by mergeable sketches that can be kept as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a level; a rank is off by about 1.3 / SIZE at most, with the usual confidence.
SIZE = 200


def sketch(df: DataFrame, by: list[str], value: str, name: str = "sketch") -> DataFrame:
    """One sketch a group, folded in each task before anything is sent. Nulls count nothing; NaN is no number."""
    some = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return some.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias(name))


def merged(sketches: DataFrame, by: list[str], name: str = "sketch") -> DataFrame:
    """Sketches of equal groups as one: those of days make a month, those of runs a history."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double(name, SIZE).alias(name))


def quantiles(sketches: DataFrame, by: list[str], probabilities: list[float], name: str = "sketch") -> DataFrame:
    """(by, p, value, n): a row for each group and probability; n values stand behind it."""
    listed = F.array(*[F.lit(float(x)) for x in probabilities])
    both = F.explode(F.arrays_zip(listed.alias("p"), F.kll_sketch_get_quantile_double(name, listed).alias("value"))).alias("q")
    return sketches.select(*by, both, F.kll_sketch_get_n_double(name).alias("n")).select(*by, "q.p", "q.value", "n")
