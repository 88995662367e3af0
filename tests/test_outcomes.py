import random

import pytest
from pyspark.sql import functions as F

from clientele.operators import feedback as fb
from clientele.operators import outcomes as out
from clientele.schemas import HEALTH_DELTAS, TABLES
from clientele.sources import sinks
from tests.conftest import at

NOW = "2024-01-31 00:00:00"


@pytest.fixture
def tables(frame):
    rows = dict(
        customers=[dict(customer_id="A", name="Ada Byron", plan="Starter", mrr=49.0, health_score=95.0, signup_date=at(1))],
        agent_actions=[
            dict(action_id="1", customer_id="A", action_type="send_upgrade_offer", priority=4, status="pending", urgency_score=9.0,
                 metadata='{"context":{"suggested_plan":"Enterprise"}}', reason="r", created_at=at(30)),
            dict(action_id="2", customer_id="Z9", action_type="proactive_support_call", priority=5, status="pending", urgency_score=8.0),
            dict(action_id="3", customer_id="A", action_type="send_health_checkin", priority=1, status="executed", outcome="bounced", executed_at=at(2)),
        ],
    )
    return {name: frame(name, rows.get(name, [])) for name in TABLES}


def given(spark):
    return spark.createDataFrame([("1", "upgraded"), ("3", "upgraded"), ("77", "upgraded")], "action_id string, outcome string")


def test_batch_is_a_dry_run_with_messages(spark, tables):
    batch = {r["action_id"]: r for r in out.execution_batch(tables, given(spark), NOW, 10).collect()}
    assert set(batch) == {"1", "2"}
    assert batch["1"]["subject"] == "From Starter to Enterprise with 15% off" and batch["1"]["outcome_class"] == "success"
    assert batch["2"]["outcome"] == "completed" and batch["2"]["outcome_class"] == "neutral"
    assert "Z9 (Z9), plan Unknown" in batch["2"]["body"] and batch["2"]["channel"] == "internal_task"
    assert tables["agent_actions"].filter("status = 'pending'").count() == 2
    assert out.execution_batch(tables, given(spark), NOW, 10, ["2"]).count() == 1


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Tokyo"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_committing_a_batch(spark, tables, tmp_path, zone):
    path, log, staging = (str(tmp_path / n) for n in ("actions", "log", "staging"))
    sinks.write_actions(tables["agent_actions"], path)
    batch = out.execution_batch(tables, given(spark), NOW, 1)
    for _ in range(2):
        sinks.commit_outcomes(spark, path, batch, staging)
        sinks.append_email_log(spark, out.email_log_rows(batch), log)
    rows = {r["action_id"]: r for r in sinks.read_actions(spark, path).collect()}
    assert len(rows) == sinks.read_actions(spark, path).count() == 3
    assert (rows["1"]["status"], rows["1"]["outcome"]) == ("executed", "upgraded") and rows["2"]["status"] == "pending"
    logged = spark.read.parquet(log).collect()
    assert [(r["email_id"], r["opened"], r["clicked"]) for r in logged] == [("ACT-1", 1, 1)]


def test_commit_recovers_from_a_lost_pending_part(spark, tables, tmp_path):
    """The attempt died while the pending part was being replaced: its files are gone, the staged rows are not."""
    path, staging = str(tmp_path / "actions"), str(tmp_path / "staging")
    sinks.write_actions(tables["agent_actions"], path)
    batch = sinks.write_once(out.execution_batch(tables, given(spark), NOW, 1), f"{staging}/batch")
    pending = sinks.read_actions(spark, path).filter("status = 'pending'")
    sinks.write_once(pending.join(batch.select("action_id"), "action_id", "left_anti"), f"{staging}/pending")
    sinks.write_pending(pending.limit(0), path)
    now = {**tables, "agent_actions": sinks.read_actions(spark, path)}
    sinks.commit_outcomes(spark, path, out.execution_batch(now, given(spark), NOW, 1), staging)
    rows = {r["action_id"]: r["status"] for r in sinks.read_actions(spark, path).collect()}
    assert rows == {"1": "executed", "2": "pending", "3": "executed"}


def test_commit_after_the_end_leaves_a_newer_queue_alone(spark, tables, frame, tmp_path):
    path, staging = str(tmp_path / "actions"), str(tmp_path / "staging")
    sinks.write_actions(tables["agent_actions"], path)
    batch = out.execution_batch(tables, given(spark), NOW, 1)
    sinks.commit_outcomes(spark, path, batch, staging)
    sinks.write_pending(frame("agent_actions", [dict(action_id="9", status="pending")]), path)
    sinks.commit_outcomes(spark, path, batch, staging)
    rows = {r["action_id"]: r["status"] for r in sinks.read_actions(spark, path).collect()}
    assert rows == {"1": "executed", "3": "executed", "9": "pending"}


def test_outcomes_touch_pending_rows_only(spark, tables):
    rows = {r["action_id"]: r for r in out.apply_outcomes(tables["agent_actions"], given(spark), NOW).collect()}
    assert rows["1"]["status"] == "executed" and rows["3"]["outcome"] == "bounced" and rows["2"]["status"] == "pending"


def test_report_totals(spark):
    df = spark.createDataFrame([("a", "upgraded"), ("a", "bounced"), ("b", None), ("b", "replied_negative")], "action_type string, outcome string")
    rows = {r["action_type"]: r for r in out.execution_report(df).collect()}
    assert (rows["ALL"]["total"], rows["ALL"]["success"], rows["ALL"]["neutral"], rows["ALL"]["failure"]) == (4, 2, 1, 1)
    assert rows["a"]["success_rate"] == 0.5


def executed(frame, *rows):
    return frame("agent_actions", [
        dict(action_id=f"{n:04d}", customer_id=c, outcome=o, status="executed", executed_at=t) for n, (c, o, t) in enumerate(rows)
    ])


def health(df):
    return {r["customer_id"]: r["health_score"] for r in df.collect()}


def people(frame, **scores):
    return frame("customers", [dict(customer_id=c, health_score=h) for c, h in scores.items()])


def test_clamp_and_order(spark, frame):
    batch = executed(
        frame, ("A", "upgraded", at(30)), ("B", "call_completed_churned", at(30)), ("C", "call_completed_churned", at(30)),
        ("C", "discount_redeemed", at(30, 1)), ("D", "unheard_of", at(30)), ("E", "upgraded", at(30)), ("F", None, at(30)),
    )
    got = health(fb.apply_health(people(frame, A=95.0, B=3.0, C=3.0, D=7.0, E=None, F=1.0), batch))
    assert got == {"A": 100.0, "B": 0.0, "C": 5.0, "D": 7.0, "E": None, "F": 1.0}


@pytest.mark.parametrize("slices", [1, 7])
def test_fold_matches_a_plain_loop_for_a_hot_customer(spark, frame, slices):
    chance = random.Random(slices)
    labels = [*HEALTH_DELTAS, "unheard_of"]
    rows = [(chance.choice(["HOT", "HOT", "A", "B"]), chance.choice(labels), at(chance.randint(1, 3))) for _ in range(600)]
    start = {"HOT": 50.0, "A": 1.0, "B": 99.5}
    expected = dict(start)
    for n, (customer, outcome, when) in sorted(enumerate(rows), key=lambda x: (x[1][2], f"{x[0]:04d}")):
        expected[customer] = min(100.0, max(0.0, expected[customer] + HEALTH_DELTAS.get(outcome, 0.0)))
    steps = fb.health_steps(executed(frame, *rows), slices)
    assert health(fb.apply_steps(people(frame, **start), steps)) == expected


def test_feedback_applies_once(spark, frame):
    actions = executed(frame, ("A", "upgraded", at(30, 12)), ("A", "already_enrolled", at(30, 13)), ("A", "upgraded", at(1)))
    batch = fb.pending_feedback(actions, NOW, 24)
    assert batch.count() == 2
    marked = fb.mark_applied(actions, batch, NOW)
    assert marked.filter("feedback_applied_at IS NOT NULL").count() == 2
    again = fb.pending_feedback(marked, NOW, 24)
    assert again.count() == 0 and fb.feedback_summary(again).count() == 0
    row = fb.feedback_summary(batch).first()
    assert (row["executions_processed"], row["health_updates"], row["upgrades_confirmed"]) == (2, 1, 1)


def test_every_outcome_has_a_delta(spark):
    df = spark.createDataFrame([(k,) for k in HEALTH_DELTAS], "outcome string")
    got = {r[0]: r[1] for r in df.select("outcome", fb.health_delta(F.col("outcome"))).collect()}
    assert got == HEALTH_DELTAS


def test_copies_of_an_outcome_change_one_action(spark, tables):
    copies = given(spark).unionByName(given(spark))
    assert out.apply_outcomes(tables["agent_actions"], copies, NOW).count() == 3
    assert out.execution_batch(tables, copies, NOW, 10).count() == 2
