"""Every catalog query against its SQL twin, and what the plans must not contain."""

from __future__ import annotations

import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


MAP_ONLY = [n for n in QUERIES if re.match(r"(py|cpp|js|jl)_", n) and n != "jl_merge"] + ["kb_json", "kb_export", "file_category"]


@pytest.mark.parametrize("name", MAP_ONLY)
def test_extraction_plans_do_not_shuffle(spark, name):
    """One exchange at most: the spread of a small input, which large inputs skip."""
    plan = plan_of(QUERIES[name](spark, SF))
    # The ignore list is one configuration file; gathering it is no shuffle of files.
    exchanges = [x for x in plan.split("\n") if re.search(r"\bExchange\b", x) and "SinglePartition" not in x]
    assert all("REPARTITION_BY_NUM" in x for x in exchanges) and len(exchanges) <= 1
    assert "Python" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["change_context", "kb_staleness", "context_text", "ignore_match"])
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
