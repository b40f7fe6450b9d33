"""The working folder: tables written in the shared folder and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.session import shared_root

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    for path in _made:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs the tasks that ran on it, not
    the plan above. Parquet is smaller than an RDD checkpoint of the same rows.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    held = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")  # what this write has shuffled goes when it is done, not when the driver collects garbage
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, held)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a materialize()d table that nothing reads any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
