"""Each registered query against its expected result as SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from checks import oracle
from checks.queries import QUERIES

EXPECTED = oracle.oracle_sql()


@pytest.fixture(scope="module")
def engine(small_folder):
    con = duckdb.connect()
    for path in glob.glob(f"{small_folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_states_its_result():
    assert set(QUERIES) == set(EXPECTED)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(EXPECTED) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, engine, small_folder, key):
    df = QUERIES[key](spark, small_folder)
    engine.execute(EXPECTED[key])
    names = [d[0] for d in engine.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(engine.fetchall(), names)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
