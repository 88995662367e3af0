import math

import pytest
from pyspark.sql import functions as F

from clientele.operators import features as feat
from clientele.schemas import TABLES
from tests.conftest import AS_OF, at


@pytest.fixture
def tables(frame):
    people = [
        dict(customer_id="C1", name="Ada L", email="a", plan="Pro", mrr=200.0, signup_date=at(1), health_score=50.0,
             nps_score=10, employee_count=5, is_churned=0),
        dict(customer_id="C2", name="Bo", email="b", plan="Gold", mrr=None, signup_date=at(9, 1, month=2),
             health_score=None, nps_score=None, employee_count=None, is_churned=1),
    ]
    txns = [
        dict(txn_id="T1", customer_id="C1", amount=100.0, status="completed", txn_date=at(5)),
        dict(txn_id="T2", customer_id="C1", amount=-40.0, status="refunded", txn_date=at(20)),
        dict(txn_id="T3", customer_id=None, amount=7.0, status="completed", txn_date=at(20)),
    ]
    events = [
        dict(event_id="E1", customer_id="C1", event_type="login", channel="Email", session_duration=60, event_date=at(11)),
        dict(event_id="E2", customer_id="C1", event_type="login", channel="SMS", session_duration=None, event_date=at(10, 23, 59, 59)),
        dict(event_id="E3", customer_id="C1", event_type="view", channel=None, session_duration=30, event_date=at(31, 12)),
    ]
    tickets = [
        dict(ticket_id="K1", customer_id="C1", topic="cancellation", status="open", priority="critical", sentiment_score=-0.5),
        dict(ticket_id="K2", customer_id="C1", topic="billing", status="in_progress", priority="low", sentiment_score=None),
    ]
    mails = [
        dict(email_id="M1", customer_id="C1", opened=1, clicked=1),
        dict(email_id="M2", customer_id="C1", opened=0, clicked=0),
    ]
    rows = dict(customers=people, transactions=txns, engagement_events=events, support_tickets=tickets, email_log=mails)
    return {name: frame(name, rows.get(name, [])) for name in TABLES}


def test_feature_values(tables):
    row = feat.build_customer_features(tables, AS_OF).filter("customer_id = 'C1'").first().asDict()
    expected = dict(
        tenure_days=40, plan_rank=2, txn_count=2, total_spend=60.0, avg_order_value=30.0, refund_count=1,
        refund_rate=0.5, last_txn_days_ago=21, event_count_total=3, event_count_30d=2, avg_session_sec=45.0,
        unique_channels=2, unique_event_types=2, days_since_last_event=9, ticket_count=2, open_tickets=1,
        critical_tickets=1, avg_sentiment=-0.5, cancellation_risk=1, unresolved_rate=0.5, emails_sent=2,
        open_rate=0.5, click_rate=0.5, recency_score=86.5, engagement_index=19.75, risk_index=42.5, has_events=True,
    )
    assert {k: row[k] for k in expected} == expected


def test_inactive_customer_gets_zeros(tables):
    row = feat.build_customer_features(tables, AS_OF).filter("customer_id = 'C2'").first().asDict()
    assert row["plan"] == "Gold" and row["plan_rank"] == 0 and row["tenure_days"] == 0
    assert row["days_since_last_event"] == 0 and row["recency_score"] == 100.0 and row["has_events"] is False
    assert all(row[name] is not None for name in feat.feature_columns())


def test_one_row_per_customer_and_28_features(tables):
    assert len(feat.feature_columns()) == 28
    assert feat.build_customer_features(tables, AS_OF).count() == 2


def test_context_counts_open_tickets_once(tables, spark):
    ids = spark.createDataFrame([("C1",), ("C2",), ("C9",)], "customer_id string")
    for one_page in (False, True):
        rows = {r["customer_id"]: r for r in feat.action_context(tables, ids, AS_OF, one_page).collect()}
        assert set(rows) == {"C1", "C2"}
        assert (rows["C1"]["open_tickets"], rows["C1"]["open_tickets_fanout"]) == (1, 3)
        assert rows["C1"]["days_since_last_event"] == 9 and rows["C1"]["avg_sentiment"] == -0.5
        assert rows["C2"]["open_tickets_fanout"] == 0 and rows["C2"]["tenure_days"] == 0


def test_hot_customer_matches_brute_force(spark):
    """A third of the events belongs to one customer."""
    events = spark.range(30000).select(
        F.concat(F.lit("E"), "id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), (F.col("id") % 997).cast("string"))).alias("customer_id"),
        F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("event_type"),
        F.concat(F.lit("c"), (F.col("id") % 11).cast("string")).alias("channel"),
        (F.col("id") % 100).cast("int").alias("session_duration"),
        F.lit("2024-02-01").cast("timestamp_ntz").alias("event_date"),
    )
    rows = {r["customer_id"]: r for r in feat.engagement_features(events, AS_OF).collect()}
    hot = rows["HOT"]
    assert hot["event_count_total"] == 10000 and hot["unique_channels"] == 11 and hot["unique_event_types"] == 7
    assert math.isclose(hot["avg_session_sec"], sum(i % 100 for i in range(0, 30000, 3)) / 10000)
    assert sum(r["event_count_total"] for r in rows.values()) == 30000


def test_events_are_counted_before_the_distinct_expansion(tables):
    plan = feat.engagement_features(tables["engagement_events"], AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.index("partial_sum(session_duration")
