"""Every query with an oracle gives the oracle's rows; the others give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, data_dir, duck, name):
    df = QUERIES[name](spark, data_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(duck, name, df, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry_is_the_flagship(spark):
    assert set(entry.entry(spark).columns) >= {"process_id", "hubo", "cantidad", "tipos", "detalle"}
