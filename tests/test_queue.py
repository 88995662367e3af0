import pytest

from clientele.operators import queue as que
from clientele.operators import reports as rep
from clientele.sources import sinks
from clientele.sources.merge import replace_pending
from tests.conftest import at

NOW = "2024-01-31 00:00:00"
PLAN_SCHEMA = (
    "customer_id string, action_type string, reason string, priority int, rule_id string, llm_enhanced boolean,"
    " confidence double, metadata string, ltv_estimate double"
)


def plans(spark, *rows):
    return spark.createDataFrame(
        [(c, a, "r", p, "R", False, conf, '{"context":{}}', ltv) for c, a, p, conf, ltv in rows], PLAN_SCHEMA
    )


def done(action_id, customer, action, when, **more):
    return dict(action_id=action_id, customer_id=customer, action_type=action, status="executed", executed_at=when, **more)


def test_urgency_is_monotone_and_survives_missing_value(spark):
    rows = [("A", "x", 5, 0.7, 0.0), ("A", "x", 3, 0.7, 0.0), ("A", "x", 3, 0.9, 0.0), ("A", "x", 3, 0.7, 1000.0),
            ("A", "x", 3, 0.7, 1e9), ("A", "x", 3, 0.7, None), ("A", "x", 3, 0.7, float("nan"))]
    score = que.urgency_score
    df = plans(spark, *rows)
    got = [r[0] for r in df.select(score(df["priority"], df["confidence"], df["ltv_estimate"])).collect()]
    assert got == pytest.approx([16.05, 10.05, 10.35, 11.05, 12.05, 10.05, 10.05])


def test_cooldown_per_action(spark, frame):
    actions = frame("agent_actions", [
        done("1", "A", "send_upgrade_offer", at(21, 0, 0, 1)),  # 9 whole days of 10
        done("2", "B", "send_upgrade_offer", at(21)),  # exactly 10
        done("3", "C", "unheard_of", at(25)),  # 6 of the default 7
        done("4", "D", "no_action", at(30)),
        done("5", "E", "send_loyalty_reward", at(1)),
        done("6", "E", "send_loyalty_reward", at(2)),
        dict(action_id="7", customer_id="F", action_type="send_upgrade_offer", status="pending", executed_at=at(30)),
    ])
    pairs = {tuple(r) for r in que.cooldown_pairs(actions, NOW).collect()}
    assert pairs == {("A", "send_upgrade_offer"), ("C", "unheard_of"), ("E", "send_loyalty_reward")}


def test_queue_rows_and_order(spark, frame):
    actions = frame("agent_actions", [done("1", "A", "send_upgrade_offer", at(30))])
    df = plans(spark, ("A", "send_upgrade_offer", 5, 0.7, 0.0), ("A2", "send_upgrade_offer", 1, 0.7, 0.0),
               ("B", "send_health_checkin", 5, 0.7, 10.0), ("A", "send_loyalty_reward", 3, 0.7, 0.0))
    queue = que.build_queue(df, actions, NOW)
    assert queue.schema.names == actions.schema.names
    top = que.pending_queue(queue, 10).collect()
    assert [r["priority"] for r in top] == [5, 3, 1]
    assert len({r["action_id"] for r in top}) == 3 and all(r["metadata"] == '{"context":{}}' for r in top)
    again = que.build_queue(df, actions, NOW)
    assert {r["action_id"] for r in again.collect()} == {r["action_id"] for r in top}


def test_page_limits(spark, frame):
    actions = frame("agent_actions", [])
    with pytest.raises(ValueError):
        que.action_queue(actions, limit=501)
    assert que.pending_queue(actions, 10**6).collect() == []
    with pytest.raises(ValueError):
        que.pending_queue(actions, -1)
    with pytest.raises(ValueError):
        rep.list_customers(frame("customers", []), frame("ml_predictions", []), offset=-1)


def test_priority_zero_is_no_filter(spark, frame):
    rows = [dict(action_id=str(i), customer_id="A", status="pending", priority=i % 3 + 1, urgency_score=float(i)) for i in range(6)]
    actions = frame("agent_actions", rows)
    assert que.action_queue(actions, priority=0).count() == 6 and que.action_queue(actions, priority=2).count() == 2


def test_replacing_pending_keeps_history(spark, frame, tmp_path):
    old = frame("agent_actions", [done("1", "A", "x", at(3)), dict(action_id="2", customer_id="A", status="pending")])
    new = frame("agent_actions", [dict(action_id="3", customer_id="B", status="pending")])
    path = str(tmp_path / "actions")
    sinks.write_actions(old, path)
    for queue, expected in ((new, {("1", "executed"), ("3", "pending")}), (new.limit(0), {("1", "executed")})):
        got = replace_pending(old, queue)
        assert {(r["action_id"], r["status"]) for r in got.collect()} == expected
        sinks.write_pending(queue, path)
        assert {(r["action_id"], r["status"]) for r in sinks.read_actions(spark, path).collect()} == expected
