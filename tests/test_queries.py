"""Every registered query against its SQL, and rules its plan must keep."""

import os

import pytest

import __spark_entry__ as E
from biosieve.bindings.base import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# plan nodes that mean a cross product or per-row Python (climate matching alone works on array blocks)
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    fn = E.queries()[name]
    planned = []

    def run(session, sf_dir):
        df = fn(session, sf_dir)
        planned.append(df)
        return df

    assert compare(spark, con, SF, run, E.oracle_sql()[name]) is None
    plan = planned[0]._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BANNED if node in plan]


def test_entry(spark):
    assert E.entry(spark).count() > 0
