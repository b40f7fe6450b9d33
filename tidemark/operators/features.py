"""Feature operators: roles by name suffix, look-back, pivots, undersampling, frame helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The suffixes that give a column its role.
CONTINUOUS = ("_cnt", "_amt", "_arpu", "_mb", "_qty", "_age", "_score", "_price", "_ratio", "_duration", "_avg", "_distance", "_entropy")
CATEGORY = ("_cd", "_yn", "_rank", "_type", "_typ")
EXCLUDED = ("click_yn", "hour_gap", "chnl_typ", "cmpgn_typ")


def role_of(name: str) -> str:
    """token, excluded, continuous, category, vector or other; continuous is tested before category."""
    if name.endswith("_token"):
        return "token"
    if name in EXCLUDED:
        return "excluded"
    if name.endswith(CONTINUOUS):
        return "continuous"
    if name.endswith(CATEGORY):
        return "category"
    return "vector" if name.endswith("_vec") else "other"


def role_projection(df: DataFrame) -> DataFrame:
    """Normalises each column by its role: missing tokens become ['#'], numbers NaN, categories 'UKV'."""

    def cast(name: str) -> Column:
        c, role = F.col(name), role_of(name)
        if role == "token":
            return F.coalesce(c, F.array(F.lit("#"))).alias(name)
        if role == "continuous":
            return F.coalesce(c.cast("float"), F.lit(float("nan")).cast("float")).alias(name)
        if role == "category":
            return F.when(c.isNull() | (c.cast("string") == ""), "UKV").otherwise(c.cast("string")).alias(name)
        return c

    return df.select(*map(cast, df.columns))


def dict_filter(df: DataFrame, conditions: dict[str, object], operator: str = "AND") -> DataFrame:
    """Rows whose columns equal the given values, or are in the given lists, joined by AND or OR.

    No condition returns df itself; another operator or a missing column raises.
    """
    if operator.upper() not in ("AND", "OR"):
        raise ValueError(f"unknown operator {operator!r}")
    if missing := [c for c in conditions if c not in df.columns]:
        raise KeyError(f"no such column: {missing}")
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in conditions.items()]
    if not tests:
        return df
    return df.filter(reduce(lambda a, b: a & b if operator.upper() == "AND" else a | b, tests))


def keep_first(df: DataFrame, keys: Iterable[str], *order: Column) -> DataFrame:
    """One row per key: the first by a total order, so that the survivor never depends on the run."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def lookback(df: DataFrame, keys: list[str], period: str, value: str, n: int, out: str, direction: str = "back") -> DataFrame:
    """Per key and period the sum of value over the n periods before it (or after, for 'forward').

    Every row is emitted under each period that looks at it and summed there: an
    equi-aggregation in place of a range self-join. Periods are dates of a month's
    first day.
    """
    sign = 1 if direction == "back" else -1
    shifted = df.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"), period, value)
    moved = shifted.withColumn(period, F.add_months(F.col(period), sign * F.col("_k")))
    return moved.groupBy(*keys, period).agg(F.sum(value).alias(out))


def lookback_counts(rows: DataFrame, keys: list[str], period: Column, n: int, own: str, out: str) -> DataFrame:
    """(keys, period, own, out): the rows of each key and period that has any, and those of the n periods before it.

    Each row counts under its own period and the n after it, so one aggregation does both.
    """
    seen = rows.select(*keys, period.alias("period"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_k"))
    moved = seen.withColumn("period", F.add_months("period", F.col("_k")))
    counts = moved.groupBy(*keys, "period").agg(F.count(F.when(F.col("_k") == 0, 1)).alias(own), F.count(F.when(F.col("_k") > 0, 1)).alias(out))
    return counts.filter(F.col(own) > 0)


def merge_frames(frames: list[DataFrame], on: list[str], how: str = "outer") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), frames)


def generic_agg(df: DataFrame, by: list[str], spec: dict[str, str | list[str]]) -> DataFrame:
    """Aggregates columns by function names; the results are called column_function."""
    known = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct}
    wanted = [(c, f) for c, fs in spec.items() for f in ([fs] if isinstance(fs, str) else fs)]
    return df.groupBy(*by).agg(*[known[f](c).alias(f"{c}_{f}") for c, f in wanted])


def undersample_ratios(df: DataFrame, keys: list[str], label: str, mult: float) -> DataFrame:
    """Per key and label: count, the least count over the key's labels, and the share of rows to keep."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("cnt"))
    least = F.min("cnt").over(Window.partitionBy(*keys))
    return counts.withColumn("min_cnt", least).withColumn("ratio", F.least(F.lit(1.0), mult * F.col("min_cnt") / F.col("cnt")))


def undersample(df: DataFrame, keys: list[str], label: str, mult: float, order: Column) -> DataFrame:
    """Keeps each group's ratio of rows, those with the least hash of order; the same rows on every run."""
    ratios = undersample_ratios(df, keys, label, mult).select(*keys, label, "ratio")
    draw = F.pmod(F.xxhash64(order), F.lit(1_000_000)) / 1_000_000
    return df.join(ratios, [*keys, label]).filter(draw <= F.col("ratio")).drop("ratio")


def sliding_groups(items: list, size: int, slide: int) -> list[list]:
    """Groups of size items, each slide items after the last; the last ones may be shorter."""
    out, at = [], 0
    while at < len(items):
        out.append(items[at : at + size])
        if at + size >= len(items):
            break
        at += slide
    return out


def previous_months(last: str, n: int) -> list[str]:
    """The n months up to and including last (yyyyMM), ascending."""
    year, month = int(last[:4]), int(last[4:])
    months = [year * 12 + month - 1 - k for k in range(n)][::-1]
    return [f"{m // 12:04d}{m % 12 + 1:02d}" for m in months]
