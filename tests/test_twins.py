import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.oracle_sql import ORACLE_SQL
from clientele.queries import QUERIES
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_twin(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 205


SCALABLE = sorted(n for n in ORACLE_SQL if n not in ("python_rule_candidates", "batch_rule_candidates") and not n.startswith("streamed_"))
# One row per segment, cluster or result column reaches these windows and aggregates.
SMALL_WINDOWS = {"segment_counts", "cluster_profiles", "segment_model_report"}


@pytest.mark.parametrize("name", SCALABLE)
def test_plan_has_no_product_no_python_no_global_window(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    if name not in SMALL_WINDOWS:
        assert "Window" not in plan
