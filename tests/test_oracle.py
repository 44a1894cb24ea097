"""Every registered query runs; those with SQL agree with it, at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import as_frame, canonical, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    ours = as_frame(df)
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(ours) > 0
        return
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    theirs = type(ours)(result.fetchall(), columns=cols, dtype=object)
    assert sorted(ours.columns) == sorted(cols)
    assert canonical(ours) == canonical(theirs)
