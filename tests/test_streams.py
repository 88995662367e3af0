import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clientele.operators.feedback import apply_health
from clientele.sources.driver_tables import AS_OF, crm_table
from clientele.streaming.engagement import compact_daily, daily_counts, rolling_counts, start_engagement
from clientele.streaming.feedback import current_health, start_feedback
from clientele.streaming.windows import append_to, appended, ordered_health, ordered_steps, rolling_event_counts
from tests.conftest import SF_DIR, at


def health(df):
    return {r["customer_id"]: r["health_score"] for r in df.collect()}


def test_outcomes_count_once_however_often_they_arrive(spark, tmp_path):
    people = crm_table(spark, SF_DIR, "customers")
    events = crm_table(spark, SF_DIR, "agent_actions").filter("status = 'executed'").select(
        "action_id", "customer_id", "outcome", "executed_at"
    )
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(source)
        start_feedback(stream, state).awaitTermination()

    early, late = events.filter(F.dayofmonth("executed_at") <= 15), events.filter(F.dayofmonth("executed_at") > 15)
    # Late days first: their outcomes have to be applied after those that arrive next.
    late.write.mode("append").parquet(source)
    run()
    early.unionByName(late).unionByName(early.limit(20)).write.mode("append").parquet(source)
    run()
    run()
    expected = health(apply_health(people, events))
    got = health(current_health(spark, people, state))
    assert got.keys() == expected.keys()
    assert all(abs(got[c] - expected[c]) < 1e-9 for c in expected)


def test_late_events_are_counted(spark, tmp_path):
    events = crm_table(spark, SF_DIR, "engagement_events").select("event_id", "customer_id", "event_date")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in (F.dayofmonth("event_date") > 20, F.dayofmonth("event_date") <= 20):
        events.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        start_engagement(stream, state).awaitTermination()
    events.limit(300).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    start_engagement(stream, state).awaitTermination()
    daily = daily_counts(spark, state)
    assert compact_daily(spark, state, str(tmp_path / "compact")).count() == daily.count()
    assert daily.agg(F.sum("events")).first()[0] == events.count()
    expected = events.filter("event_date >= '2024-01-11'").groupBy("customer_id").count().collect()
    assert {(r[0], r[1]) for r in rolling_counts(daily, AS_OF).collect()} == {(r[0], r[1]) for r in expected}


def run_parts(spark, path, schema, parts, stream):
    """One run of the stream for each part that arrives, each from the checkpoint of the one before."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        append_to(stream(spark.readStream.schema(schema).parquet(f"{path}/in")), f"{path}/state").awaitTermination()
    return appended(spark, f"{path}/state")


def test_rolling_windows_drop_what_is_too_late_and_count_copies_once(spark, tmp_path):
    parts = [
        [("E1", "A", at(1, 5)), ("E2", "A", at(3, 6)), ("E3", None, at(3)), (None, "A", at(3))],
        [("E1", "A", at(2, 5)), ("E4", "A", at(2, 7)), ("E5", "B", at(6))],  # a copy under another day, and a late one in time
        [("E6", "A", at(1, 1)), ("E7", "B", at(7))],  # older than the newest of before by more than the delay
        [("end", "-", at(28, month=12))],
    ]
    rows = run_parts(
        spark, str(tmp_path), "event_id string, customer_id string, event_date timestamp_ntz", parts,
        lambda s: rolling_event_counts(s, "4 days", "2 days", "1 day"),
    )
    got = {(r["customer_id"], r["until"].day): r["event_count"] for r in rows.filter("customer_id <> '-'").collect()}
    assert got == {("A", 2): 1, ("A", 3): 2, ("A", 4): 2, ("A", 5): 1, ("B", 7): 1, ("B", 8): 2, ("B", 9): 1}


@pytest.mark.parametrize("length,slide", [("30 days", "1 day"), ("36 hours", "1 day"), ("6 hours", "90 minutes")])
def test_rolling_windows_of_any_length(spark, tmp_path, length, slide):
    """Against windows counted one by one; a customer has a few rows of state however many windows hold its events."""
    rng = random.Random(3)
    first = dt.datetime(2023, 12, 20)
    events = [(f"E{k}", rng.choice("AB"), first + dt.timedelta(minutes=rng.randrange(60 * 24 * 25))) for k in range(120)]
    schema = "event_id string, customer_id string, event_date timestamp_ntz"
    spark.createDataFrame(events + [("end", "-", at(28, month=12))], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rolling_event_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "2 days", length, slide)
    query = append_to(stream, f"{tmp_path}/state")
    query.awaitTermination()
    hour = dt.timedelta(hours=1)
    whole, step = {"30 days": 720 * hour, "36 hours": 36 * hour, "6 hours": 6 * hour}[length], {"1 day": 24 * hour, "90 minutes": 1.5 * hour}[slide]
    expected = {}
    for _, customer, time in events:
        own = (time - dt.datetime(1970, 1, 1)) // step
        for k in range(own - whole // step + 1, own + 1):
            key = customer, dt.datetime(1970, 1, 1) + k * step + whole
            expected[key] = expected.get(key, 0) + 1
    rows = appended(spark, f"{tmp_path}/state").filter("customer_id <> '-'").collect()
    assert len(rows) == len(expected) and {(r["customer_id"], r["until"]): r["event_count"] for r in rows} == expected
    if length == "30 days":
        # All days of the 25 and the windows that hold them were over 80 rows.
        states = [[o["numRowsTotal"] for o in p["stateOperators"] if o["operatorName"] != "dedupeWithinWatermark"] for p in query.recentProgress]
        assert max(map(sum, states)) <= 2 * 3 + 3


def test_outcomes_in_event_order_with_copies_under_another_day(spark, frame, tmp_path):
    people = frame("customers", [dict(customer_id="A", health_score=98.0), dict(customer_id="B", health_score=1.0)])
    schema = "action_id string, customer_id string, outcome string, executed_at timestamp_ntz"
    first, second = ("1", "A", "call_completed_churned", at(2, 10)), ("2", "A", "upgraded", at(2, 9))  # clamped at 100 first, then down
    parts = [
        [first, ("3", "B", "unsubscribed", at(3))],
        [second, (first[0], first[1], first[2], at(3, 10)), ("4", "B", "upgraded", at(4)), ("5", "B", "unknown", at(4))],
        [("end", "-", "unknown", at(28, month=12))],
    ]
    run_parts(spark, str(tmp_path), schema, parts, lambda s: ordered_steps(s, "10 days"))
    assert health(ordered_health(spark, people, str(tmp_path / "state"))) == {"A": 90.0, "B": 10.0}
