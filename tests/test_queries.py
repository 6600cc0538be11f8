"""Every registered query against its SQL in DuckDB.  ``QUERY_SF_DIR`` names the tables (default sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from typeloom.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(SF_DIR)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def comparable(value):
    """A value with its type, so that 1 and 1.0 differ."""
    if isinstance(value, float) and math.isnan(value):
        return "float", "nan"
    if isinstance(value, (bytes, bytearray)):
        return "bytes", bytes(value)
    return type(value).__name__, value


def table(columns, found):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return [columns[n] for n in order], sorted((tuple(comparable(r[n]) for n in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, found = table(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    wanted_columns, wanted = table([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == wanted_columns
    assert found == wanted
    assert found


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice", "c_name"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
