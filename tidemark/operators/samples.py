"""Samples and shards by a hash of the key: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_part(key: Column, seed: int) -> Column:
    """The first eight hex digits of the MD5 of seed and key: uniform, and ordered like the number they stand for."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8)


def below(share: float) -> str:
    """The hex digits that a share of all hash_part() values lies below; of the whole share, a letter above them all."""
    return f"{int(share * (1 << 32)):08x}" if share < 1 else "g"


def hash_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About that share of the rows, without replacement."""
    return df.filter(hash_part(F.col(key), seed) < below(share))


def hash_sample_by(df: DataFrame, key: str, label: str, shares: dict[str, float], seed: int) -> DataFrame:
    """About each label's share of its rows; labels without a share give no rows."""
    limit = F.coalesce(*[F.when(F.col(label) == v, below(s)) for v, s in shares.items()], F.lit(""))
    return df.filter(hash_part(F.col(key), seed) < limit)


def suffix(column: Column, n: int = 1) -> Column:
    """The last n characters, by which tables are dealt into shards."""
    return F.right(column.cast("string"), F.lit(n))


def unprocessed_sample(df: DataFrame, done: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, at most, whose key done does not have: those with the least hashes of seed and key."""
    left = df.join(done.select(key).distinct(), key, "left_anti")
    return left.orderBy(hash_part(F.col(key), seed), key).limit(n)


def seeded_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with ``part``: 'train' for about that share of the keys, else 'test'; rows of one key stay together."""
    return df.withColumn("part", F.when(hash_part(F.col(key), seed) < below(share), "train").otherwise("test"))


def fold_of(key: Column, folds: int, seed: int) -> Column:
    """A fold from 0, from the hash of seed and key."""
    return (F.conv(hash_part(key, seed), 16, 10).cast("long") % folds).cast("int")
