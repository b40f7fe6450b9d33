"""Sources and sinks: CSV in unknown encodings, text lines, JSON lines, partition trees, versioned paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings tried in this order.
ENCODINGS = ("UTF-8", "x-windows-949", "EUC-KR")


def read_csv_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with header in the first encoding that decodes it without replacement characters; a byte-order mark is dropped."""
    # Spark 4 takes only a few charsets unless told otherwise
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for encoding in ENCODINGS:
        df = spark.read.options(header=True, encoding=encoding, **options).csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        bad = F.lit("".join(df.columns).find("�") >= 0)
        for c in df.columns:
            bad = bad | F.coalesce(F.contains(F.col(c).cast("string"), F.lit("�")), F.lit(False))
        if df.filter(bad).isEmpty() and "�" not in "".join(df.columns):
            return df
    raise ValueError(f"no encoding of {ENCODINGS} fits {path}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    r"""(message,): non-blank lines, with \n and \t unescaped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.replace(F.replace("value", F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")).alias("message"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, message) from JSON lines; msg_id, id, text and msg serve as other names."""
    df = spark.read.json(path)
    pick = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns] or [F.lit(None).cast("string")])
    return df.select(pick(("message_id", "msg_id", "id")).alias("message_id"), pick(("message", "msg", "text", "mms_phrs")).alias("message"))


def normalized(df: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """df with trimmed lower-case column names, and with the default columns that it lacks. Names that then clash raise."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns that differ only in case or blanks: {sorted(n for n in names if names.count(n) > 1)}")
    out = df.toDF(*names)
    return out.withColumns({n: c for n, c in (defaults or {}).items() if n not in names})


def read_jdbc(spark: SparkSession, url: str, table: str, where: str | None = None, **options) -> DataFrame:
    """A database table; the filter is pushed down."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.filter(where) if where else df


def columns_present(spark: SparkSession, table: str, wanted: list[str]) -> list[str]:
    """The wanted columns that the catalog table has, in the table's order."""
    keep = {w.lower() for w in wanted}
    return [c for c in spark.table(table).columns if c.lower() in keep]


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*by).parquet(path)


def merge_partitions(spark: SparkSession, root: str) -> DataFrame:
    """All files below root with the path values as string columns; files that begin with _ are skipped."""
    held = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.option("mergeSchema", "false").parquet(root)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", held)


def versioned_path(root: str, kind: str, first: str, last: str) -> str:
    return f"{root.rstrip('/')}/{kind}_{first}_{last}"


def export_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ("price",), base: dict[str, Column] | None = None) -> None:
    """CSV with header; drops the named columns and adds missing base columns."""
    for name, default in (base or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, default)
    df.drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str, drop: tuple[str, ...] = ("price",), base: dict[str, Column] | None = None) -> None:
    """Records as JSON lines, nulls included; drops the named columns and adds missing base columns."""
    for name, default in (base or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, default)
    df.drop(*drop).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def latest(df: DataFrame, at: str, n: int, where: Column | None = None, tie: str | None = None) -> DataFrame:
    """The n latest records that meet a condition, the latest first; rows without a time come last."""
    kept = df if where is None else df.filter(where)
    return kept.orderBy(F.desc_nulls_last(at), *([F.desc(tie)] if tie else [])).limit(n)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def with_model(df: DataFrame, prompt: str, call, out: str = "answer", retries: int = 2) -> DataFrame:
    """Adds the answers of a callable (prompt -> text) and a status; errors become rows, not failures."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            got = []
            for p in pdf[prompt]:
                error = ""
                for _ in range(retries + 1):
                    try:
                        got.append((call(p), "ok"))
                        break
                    except Exception as x:  # noqa: BLE001  any error of the model is the row's status
                        error = str(x)[:200]
                else:
                    got.append((None, f"error: {error}"))
            yield pdf.assign(**{out: [a for a, _ in got], "status": [s for _, s in got]})

    return df.mapInPandas(run, ", ".join(f"{n} {k}" for n, k in df.dtypes) + f", {out} string, status string")
