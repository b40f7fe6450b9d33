"""Round trips through sources and sinks, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, query
from tidemark.plans.session import shared_root
from tidemark.sources import files as S


def _folder(t: Tables) -> str:
    return f"{shared_root(t.spark)}/tidemark/{uuid.uuid4().hex[:12]}"


def merged(t: Tables, orders: DataFrame) -> DataFrame:
    """The orders written by year and month, and all partition files merged."""
    path = _folder(t)
    d = orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("year"), F.date_format("o_orderdate", "MM").alias("month"))
    S.write_partitions(d.repartition("year", "month"), path, ["year", "month"])
    return S.merge_partitions(t.spark, path).select("o_orderkey", "o_totalprice", "year", "month")


@query("SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%m') AS month FROM orders")
def q_partition_merge(t: Tables) -> DataFrame:
    return merged(t, t.orders)


@query("SELECT c_custkey, c_name, 'Y' AS active FROM customer")
def q_csv_round_trip(t: Tables) -> DataFrame:
    path = _folder(t)
    S.export_csv(t.customer.select("c_custkey", "c_name", F.lit(1).alias("price")), path, base={"active": F.lit("Y")})
    return S.read_csv_any(t.spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "active")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_name) END AS answer, CASE WHEN c_custkey % 3 = 0 THEN 'error: no answer' ELSE 'ok' END AS status FROM customer")
def q_model_boundary(t: Tables) -> DataFrame:
    def stub(text: str) -> str:
        if int(text.rsplit("#", 1)[1]) % 3 == 0:
            raise ValueError("no answer")
        return text.upper()

    return S.with_model(t.customer.select("c_custkey", "c_name"), "c_name", stub).select("c_custkey", "answer", "status")
