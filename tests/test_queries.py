"""Every engine query against DuckDB on the same files."""

import os

import duckdb
import pytest

from skein import oracles, queries, state_queries  # noqa: F401
from skein.functions.predicates import where
from skein.plans.view import QuerySpec

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def test_catalogue_is_complete():
    assert set(queries.QUERIES) == set(oracles.SQL)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(oracles.SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(row[i]) for i in at) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["flt_and_range"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in plan


def test_topk_needs_no_global_sort(spark):
    assert "TakeOrderedAndProject" in queries.QUERIES["topk"](spark, DATA)._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "op, pushed",
    [
        ("=", "EqualNullSafe(o_totalprice,1000.0)"),
        ("!=", "Not(EqualNullSafe(o_totalprice,1000.0))"),
        (">", "IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)"),
        (">=", "IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,1000.0)"),
        ("<", "Or(IsNull(o_totalprice),LessThan(o_totalprice,1000.0))"),
        ("<=", "Or(IsNull(o_totalprice),LessThanOrEqual(o_totalprice,1000.0))"),
    ],
)
def test_every_comparison_reaches_the_scan(spark, op, pushed):
    view = queries.BOUND.view(spark, DATA, "orders", QuerySpec(where(queries.h["orders.o_totalprice"], op, 1000.0)))
    plan = view.dataframe(ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [{pushed}]" in plan


def test_flagship_filters_reach_the_scan(spark):
    plan = queries.QUERIES["flagship"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice,1000.0)" in plan
