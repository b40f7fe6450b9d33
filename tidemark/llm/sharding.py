"""Contiguous shards of near equal bytes, from global prefix sums.

Rows are range-partitioned in key order; every partition gives one total, the
driver adds those totals up (a row a partition, never a row a document), and
each row's global byte position is its partition's base plus a running sum
inside the partition. The byte axis is cut at equal targets.

Defined cases: null text has size 1 and the CRC of the empty text; null keys
come first; equal keys are ordered by CRC and then by an arbitrary fixed row
number, so a key that holds many rows is still cut; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions


def byte_shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    narrow = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "shard-sizes",
    )
    order = ["doc_id", "text_crc32", "_row"]
    placed = materialize(
        narrow.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *order)
        .withColumn("_part", F.spark_partition_id()),
        "shard-ranges",
    )
    # One row a partition: bounded by the number of shuffle partitions, not by the input.
    totals = placed.groupBy("_part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    base, bytes_before, rows_before = [], 0, 0
    for r in totals:
        base.append((r["_part"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["b"], rows_before + r["n"]
    bases = spark.createDataFrame(base, "_part int, _bytes long, _rows long")
    inside = Window.partitionBy("_part").orderBy(*order)
    at = (
        placed.join(F.broadcast(bases), "_part")
        .withColumn("_end", F.col("_bytes") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_index", F.col("_rows") + F.row_number().over(inside) - 1)
        # the shard in which the middle of the text lies on the byte axis
        .withColumn("shard", F.expr(f"cast(least((2 * _end - size) * {n_shards} div {2 * max(bytes_before, 1)}, {n_shards - 1}) as int)"))
    )
    # One row a shard.
    first = at.groupBy("shard").agg(F.min("_index").alias("_first"))
    return at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))
