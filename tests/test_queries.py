"""Registered queries against their SQL twins on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SLOW = {"m02_silhouette_sweep"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF)
    sql = E.oracle_sql().get(name)
    if sql:
        assert compare(df, con, sql) is None
    else:
        assert df.count() > 0


def test_silhouette_sweep(spark):
    sweep = E.queries()["m02_silhouette_sweep"](spark, SF).orderBy("k").collect()
    assert [r["k"] for r in sweep] == list(range(2, 11))
    assert sweep[-1]["inertia"] < sweep[0]["inertia"]
    assert all(-1 <= r["silhouette"] <= 1 for r in sweep) and sum(r["best"] for r in sweep) == 1
