"""Every SQL-expressible query against DuckDB, and brute force for the rest."""

import math

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(theirs.columns) == names
    rows = theirs.select(*[f'"{n}"' for n in names]).fetchall()
    assert mine == sorted((tuple(map(plain, r)) for r in rows), key=repr)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
