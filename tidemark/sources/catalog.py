"""Catalog tables with partition pruning, and database tables read in parallel with pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which programs count, and the domain of organisations.
PROGRAM_FILTER = "del_yn = 'N' and aprv_op_rslt_cd = 'APPR' and exps_yn = 'Y' and cmpgn_pgm_num like '{year}%' and rmk is not null"
ORGANISATION = "R"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def save_partitioned(df: DataFrame, table: str, by: list[str]) -> None:
    """Writes df as a Parquet table of the catalog; later calls replace only the partitions that df holds."""
    spark = df.sparkSession
    ordered = df.select(*[c for c in df.columns if c not in by], *by)
    if spark.catalog.tableExists(table):
        held = spark.conf.get(_OVERWRITE)
        spark.conf.set(_OVERWRITE, "dynamic")  # insertInto takes no option for it
        try:
            ordered.write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(_OVERWRITE, held)
    else:
        ordered.repartition(*by).write.format("parquet").partitionBy(*by).saveAsTable(table)


def described(spark: SparkSession, table: str) -> list[str]:
    """The columns that DESCRIBE names, in order, partition columns once."""
    names = [r["col_name"] for r in spark.sql(f"DESCRIBE {table}").collect()]
    return [n for n in dict.fromkeys(names) if n and not n.startswith("#")]


def read_months(spark: SparkSession, table: str, wanted: list[str], column: str, months: list[str]) -> DataFrame:
    """The wanted columns that the table has (``name as alias`` renames), for a list of partition values.

    The values are literals of an IN list, so only their partitions are listed and read.
    An empty list reads nothing.
    """
    have = {c.lower() for c in described(spark, table)}
    kept = [w for w in dict.fromkeys(w.strip() for w in wanted) if w.split(" ")[0].lower() in have]
    rows = spark.table(table).filter(F.col(column).isin(months) if months else F.lit(False))
    return rows.selectExpr(*kept)


def read_database(spark: SparkSession, url: str, table: str, where: str | None = None, split: str | None = None, parts: int = 8, **options) -> DataFrame:
    """A database table with lower-case columns; ``where`` is evaluated by the database.

    With ``split``, a numeric column, the range between its least and largest value is read
    in ``parts`` queries at once; the two values are the only rows that the driver gets.
    """
    base = spark.read.format("jdbc").options(url=url, **options)
    if split:
        rows = f"(select min({split}) as lo, max({split}) as hi from {table}{' where ' + where if where else ''}) t"
        lo, hi = base.option("dbtable", rows).load().first()
        if lo is not None:
            base = base.options(partitionColumn=split, lowerBound=str(lo), upperBound=str(int(hi) + 1), numPartitions=str(parts))
    df = base.option("dbtable", f"(select * from {table} where {where}) t" if where else table).load()
    return df.toDF(*[c.lower() for c in df.columns])


def programs(spark: SparkSession, url: str, table: str, year: str, **options) -> DataFrame:
    """Approved and exposed programs of a year: number, name and clue."""
    return read_database(spark, url, table, PROGRAM_FILTER.format(year=year), **options)


def items(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Items of the item table: all but organisations."""
    return read_database(spark, url, table, f"item_dmn <> '{ORGANISATION}'", **options)


def organisations(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return read_database(spark, url, table, f"item_dmn = '{ORGANISATION}'", **options)
