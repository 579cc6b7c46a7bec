import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import boards, catalog, files, networks, reports  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        made.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return made


def rows_of(rows):
    value = lambda v: repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    found = con.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(tuple(r) for r in got.select(names).collect()) == rows_of(found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["graph_components"])
def test_graph_queries_have_all_nodes_of_the_trade(spark, name):
    nodes = lambda q: {r.node for r in catalog.QUERIES[q](spark, "/root/testdata/sf0.001").select("node").collect()}
    assert nodes(name) == nodes("graph_degree")
