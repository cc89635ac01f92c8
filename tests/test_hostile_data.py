"""All queries on tables with missing values, orphans, repeated and hot keys."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from test_queries import EXPECTED, QUERIES, table

# column → expression; columns not named are kept
SPOILED = {
    "orders": {
        "o_custkey": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 5 "
        "WHEN o_orderkey % 19 = 0 THEN 99999 ELSE o_custkey END",
        "o_orderstatus": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END",
        "o_orderdate": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END",
    },
    "customer": {
        "c_nationkey": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END",
        "c_mktsegment": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END",
    },
    "supplier": {"s_suppkey": "CASE WHEN s_suppkey = 2 THEN 777 ELSE s_suppkey END"},
    "part": {
        "p_type": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END",
        "p_size": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END",
        "p_partkey": "CASE WHEN p_partkey % 29 = 3 THEN p_partkey + 5000 ELSE p_partkey END",
    },
    "lineitem": {
        "l_orderkey": "CASE WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN NULL WHEN l_linenumber = 2 THEN 1 "
        "WHEN l_linenumber = 7 THEN l_orderkey + 100000 ELSE l_orderkey END",
        "l_partkey": "CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_linenumber = 1 THEN 7 ELSE l_partkey END",
        "l_suppkey": "CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_linenumber > 4 THEN 3 ELSE l_suppkey END",
        "l_linenumber": "CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE l_linenumber END",
        "l_quantity": "CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_quantity END",
        "l_extendedprice": "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END",
        "l_tax": "CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_tax END",
        "l_returnflag": "CASE WHEN l_orderkey % 43 = 0 THEN NULL ELSE l_returnflag END",
    },
    "events": {
        "event_id": "CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 47 = 0 THEN NULL ELSE event_id END",
        "event_type": "CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_type END",
        "value": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END",
    },
}


@pytest.fixture(scope="module")
def hostile(small_folder, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hostile")
    con = duckdb.connect()
    for path in glob.glob(f"{small_folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        changes = ", ".join(f"{sql} AS {column}" for column, sql in SPOILED.get(name, {}).items())
        columns = f"* REPLACE ({changes})" if changes else "*"
        con.execute(f"COPY (SELECT {columns} FROM '{path}') TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, hostile, key):
    folder, con = hostile
    df = QUERIES[key](spark, folder)
    con.execute(EXPECTED[key])
    names = [d[0] for d in con.description]
    assert table(df.collect(), df.columns) == table(con.fetchall(), names)
