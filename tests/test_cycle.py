import pytest

from clientele.plans.cycle import cycle_summary, decision_cycle
from clientele.operators.queue import build_queue, cooldown_pairs
from clientele.sources.driver_tables import ACTIONS_AS_OF, AS_OF, crm_tables, decision_responses
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def tables(spark):
    return crm_tables(spark, SF_DIR)


def test_cycle_invariants(spark, tables):
    cycle = decision_cycle(tables, AS_OF, decision_responses(spark, SF_DIR), 30)
    plans = cycle.plans.collect()
    assert len(plans) == len({r["customer_id"] for r in plans})
    dropped = cycle.sets.count() - len(plans)
    assert 0 <= dropped <= 30
    row = cycle_summary(cycle, AS_OF).first()
    assert row["plans"] == len(plans) and row["queued_actions"] + row["cooldown_skipped"] == row["plans"]
    assert row["customers"] == 150 and row["candidates"] == 205


def test_nothing_queued_is_cooling(spark, tables):
    cycle = decision_cycle(tables, AS_OF)
    queue = build_queue(cycle.plans.drop("cooling"), tables["agent_actions"], ACTIONS_AS_OF)
    pairs = cooldown_pairs(tables["agent_actions"], ACTIONS_AS_OF)
    assert queue.join(pairs, ["customer_id", "action_type"]).count() == 0
    assert 0 < queue.count() < cycle.plans.count()


def test_plan_of_a_lazy_cycle(spark, tables):
    """After the feature joins only the cooldown join shuffles; no Python, no product, no global window."""
    cycle = decision_cycle(tables, AS_OF, materialise=False)
    plan = cycle.queue._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Window"):
        assert node not in plan
