"""Every registered query of the triple engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from grafthorn import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_matches_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    asked = duck.execute(core.ORACLES[name])
    columns = [c[0] for c in asked.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(rows, got.columns) == rows_of(asked.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_constant_predicate_prunes_the_scan(spark):
    from grafthorn.operators.patterns import scan

    graph = core._customers(spark, SF)
    plan = scan(graph, ("?c", core.P("c_mktsegment"), "?m"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "c_acctbal" not in plan
