"""Every registered query against its SQL, and the shape of the plans."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from workload import catalog
from workload.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are absent")
_BUILT = {}


def _once(name, build):
    """A query is built once for its rows and its plan; some store tables while they are built."""

    def built(spark, sf_dir):
        if name not in _BUILT:
            _BUILT[name] = build(spark, sf_dir)
        return _BUILT[name]

    return built


# The queries of the optional package have tests of their own.
QUERIES = {name: _once(name, build) for name, build in contract.queries().items() if name in catalog.QUERIES}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, connection, name):
    good, note = compare(spark, connection, name, QUERIES[name], ORACLES[name], SMALL)
    assert good, note


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_plan_pairs_everything_or_leaves_the_jvm(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert operator not in text
    assert ("MapInArrow" in text) == (name == "request_admission")  # the only fold that functions can't express


def test_hot_keys_are_cut_before_the_shuffle(spark):
    before_shuffle = plan(spark, "latest_revision").split("Exchange")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "signal" in df.columns
