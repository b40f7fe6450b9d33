"""All queries of the library, by name, with their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.session import ship

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "q_response_fold"
_MODULES = ["response", "relational", "metrics", "allocation", "messages", "similarity", "graphs", "learning", "storage", "events_stream", "results", "further", "advanced", "records"]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


class Tables:
    """The tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables as a query under its own name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _queries[f.__name__] = run
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tidemark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
