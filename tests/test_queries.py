"""Every query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodewell.plans import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return f"{v:.8g}" if isinstance(v, float) else str(v) if isinstance(v, str) else str(int(v))

    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    numbers = lambda f: f.apply(lambda c: c.astype("float64") if str(c.dtype).lower().startswith(("int", "float", "uint")) else c)
    assert rows(numbers(got)) == rows(numbers(expected))


def test_every_query_has_a_result(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)):
        assert queries.QUERIES[name](spark, SF_DIR.replace("0.001", "0.01")).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
