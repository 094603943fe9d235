"""Every query against its SQL on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from checks.oracle import ORACLE
from checks.queries import QUERIES



@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(columns, records):
    order = sorted(columns)

    def cell(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(cell(r[columns.index(c)]) for c in order) for r in records), key=repr)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    expected = tables.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
