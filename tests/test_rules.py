import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.operators import rules as rul

NEUTRAL = dict(
    customer_id="C1", churn_score=0.1, conversion_score=0.1, mrr=10.0, plan="Pro", plan_rank=2, segment="Loyal",
    health_score=80.0, nps_score=30, tenure_days=500, days_since_last_event=5, event_count_30d=30,
    cancellation_risk=0, avg_sentiment=0.5, ticket_count=1, open_tickets=0, engagement_index=42.0, ltv_estimate=100.0,
)
SCHEMA = (
    "customer_id string, churn_score double, conversion_score double, mrr double, plan string, plan_rank int,"
    " segment string, health_score double, nps_score int, tenure_days int, days_since_last_event int,"
    " event_count_30d int, cancellation_risk int, avg_sentiment double, ticket_count int, open_tickets int,"
    " engagement_index double, ltv_estimate double"
)
FREE, STARTER = dict(plan="Free", plan_rank=0), dict(plan="Starter", plan_rank=1)

# overrides of the neutral row, rules that fire
CASES = [
    (dict(), ()),
    (dict(churn_score=0.85, mrr=200.0), ("CHN-001",)),
    (dict(churn_score=0.80, mrr=100.0), ("CHN-001",)),
    (dict(churn_score=0.80, mrr=99.9), ()),
    (dict(churn_score=0.55), ("CHN-002",)),
    (dict(churn_score=0.7999), ("CHN-002",)),
    (dict(churn_score=0.5499), ()),
    (dict(churn_score=0.35, days_since_last_event=30), ("CHN-003",)),
    (dict(churn_score=0.35, days_since_last_event=29), ()),
    (dict(churn_score=0.3499, days_since_last_event=30), ()),
    (dict(cancellation_risk=1), ("CHN-004",)),
    (dict(avg_sentiment=-0.41, ticket_count=2), ("CHN-004",)),
    (dict(avg_sentiment=-0.4, ticket_count=2), ()),
    (dict(avg_sentiment=-0.9, ticket_count=1), ()),
    (dict(conversion_score=0.7, **FREE), ("CNV-001",)),
    (dict(conversion_score=0.4, **FREE), ("CNV-002",)),
    (dict(conversion_score=0.6999, **FREE), ("CNV-002",)),
    (dict(conversion_score=0.5, event_count_30d=20, **STARTER), ("CNV-003",)),
    (dict(conversion_score=0.5, event_count_30d=19, **STARTER), ()),
    (dict(conversion_score=0.75, event_count_30d=25, **STARTER), ("CNV-001", "CNV-003")),
    (dict(segment="Champion", tenure_days=180), ("LYL-001",)),
    (dict(segment="Champion", tenure_days=179), ()),
    (dict(health_score=34.9), ("LYL-002",)),
    (dict(health_score=35.0), ()),
    (dict(health_score=34.9, churn_score=0.45), ()),
    (dict(health_score=None, segment=None), ()),
]


def rows(spark, *overrides):
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]
    data = []
    for n, override in enumerate(overrides):
        row = {**NEUTRAL, "customer_id": f"C{n}", **override}
        data.append(tuple(row[name] for name in names))
    return spark.createDataFrame(data, SCHEMA)


def test_each_threshold(spark):
    fired = {}
    for r in rul.evaluate_rules(rows(spark, *[c[0] for c in CASES])).collect():
        fired.setdefault(r["customer_id"], []).append(r["rule_id"])
    for n, (override, expected) in enumerate(CASES):
        assert tuple(fired.get(f"C{n}", ())) == expected, override


def test_candidate_content(spark):
    df = rows(spark, dict(conversion_score=0.75, event_count_30d=25, **STARTER), dict(conversion_score=0.9, **FREE))
    got = rul.evaluate_rules(df).select(
        "customer_id", "rule_id", "action_type", F.get_json_object("context", "$.suggested_plan").alias("target"),
        F.get_json_object("triggered_by", "$.plan").alias("plan"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("C0", "CNV-001", "send_upgrade_offer", "Pro", "Starter"),
        ("C0", "CNV-003", "send_upgrade_offer", "Pro", "Starter"),
        ("C1", "CNV-001", "send_upgrade_offer", "Starter", "Free"),
    ]


def test_priorities_match_the_registry(spark):
    candidates = rul.evaluate_rules(rows(spark, *[c[0] for c in CASES]))
    assert rul.priority_mismatches(candidates).count() == 0


def test_registering_a_rule(spark):
    own = list(rul.REGISTRY)
    rul.register(
        rul.Rule("X-1", 2, "send_health_checkin", lambda: F.col("nps_score") < 0, lambda: F.lit("low NPS"), ("nps_score",)), own
    )
    assert [r["rule_id"] for r in rul.evaluate_rules(rows(spark, dict(nps_score=-1)), own).collect()] == ["X-1"]
    with pytest.raises(ValueError):
        rul.register(own[0], own)
    assert len(rul.REGISTRY) == 9


def test_python_rule_isolates_errors(spark):
    def rule(row):
        if row["nps_score"] == 13:
            raise KeyError("bad")
        return {"action_type": "send_health_checkin", "reason": "r"} if row["nps_score"] < 0 else None

    df = rows(spark, dict(nps_score=-1), dict(nps_score=13), dict(nps_score=50))
    got = {r["customer_id"]: r for r in rul.evaluate_python_rule(df, "PY", 1, rule, ["nps_score"]).collect()}
    assert set(got) == {"C0", "C1"}
    assert got["C0"]["error"] is None and got["C1"]["error"].startswith("KeyError")


def test_rules_need_no_shuffle_and_no_python(spark):
    plan = rul.evaluate_rules(rows(spark, {}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" in plan


def test_enrich_defaults(spark, frame):
    features = spark.createDataFrame([("C1",), ("C2",)], "customer_id string")
    scores = frame("ml_predictions", [dict(customer_id="C1", churn_score=0.4, segment="Loyal", ltv_estimate=None)])
    got = {r["customer_id"]: r for r in rul.enrich(features, scores).collect()}
    assert got["C2"]["churn_score"] == 0.0 and got["C2"]["segment"] == "Unknown" and got["C1"]["ltv_estimate"] == 0.0


def test_summary_counts(spark):
    got = {(r["kind"], r["value"]): r["candidates"] for r in rul.rule_summary(rul.evaluate_rules(rows(spark, *[c[0] for c in CASES]))).collect()}
    assert got["rule", "CHN-002"] == 2 and got["priority", "P5 CRITICAL"] == 2 and got["action", "send_upgrade_offer"] == 4


def test_python_rule_sees_whole_numbers_and_none_and_wrong_types_are_errors(spark):
    rows = spark.createDataFrame([("A", 5), ("B", None), ("C", 7)], "customer_id string, nps_score int")

    def rule(row):
        if row["customer_id"] == "C":
            return {"action_type": "x", "reason": "y", "priority": "high"}
        return {"action_type": "x", "reason": f"NPS {row['nps_score']}"}

    got = {r["customer_id"]: r for r in rul.evaluate_python_rule(rows, "P", 2, rule, ["nps_score"]).collect()}
    assert (got["A"]["reason"], got["B"]["reason"]) == ("NPS 5", "NPS None")
    assert got["C"]["error"] == "TypeError: priority is str" and got["C"]["action_type"] is None


def test_batch_rule_isolates_the_rows_that_fail(spark):
    calls = []
    data = spark.createDataFrame([(f"C{k:03d}", k if k % 5 else None, "Pro") for k in range(400)], "customer_id string, nps_score int, plan string").coalesce(1)

    def rule(part):
        if part["customer_id"].isin(["C007", "C100", "C399"]).any():
            raise ValueError("bad row")
        hit = part[part["nps_score"] > 390]
        return pd.DataFrame({"action_type": "x", "reason": "NPS " + hit["nps_score"].astype(str), "priority": 3}, index=hit.index)

    got = {r["customer_id"]: r for r in rul.evaluate_batch_rule(data, "B", 1, rule, ["nps_score", "plan"]).collect()}
    assert {c for c, r in got.items() if r["error"]} == {"C007", "C100", "C399"}
    assert got["C007"]["error"] == "ValueError: bad row" and got["C007"]["action_type"] is None
    assert {c for c, r in got.items() if not r["error"]} == {f"C{k}" for k in range(391, 399) if k % 5}
    assert got["C391"]["reason"] == "NPS 391" and got["C391"]["priority"] == 3 and calls == []


def test_batch_rule_results_of_another_shape_are_errors(spark):
    data = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "customer_id string, nps_score int")

    def rule(part):
        out = pd.DataFrame({"action_type": "x", "reason": "y"}, index=part.index)
        if (part["nps_score"] == 2).any():
            out["priority"] = "high"
        return out.rename(index={part.index[0]: 99}) if (part["nps_score"] == 3).any() else out

    got = {r["customer_id"]: r["error"] for r in rul.evaluate_batch_rule(data, "B", 1, rule, ["nps_score"]).collect()}
    assert got["A"] is None and got["B"] == "TypeError: priority is str" and got["C"].startswith("ValueError")
    assert rul.evaluate_batch_rule(data, "B", 1, lambda part: None, ["nps_score"]).collect() == []
    assert rul.evaluate_batch_rule(data.limit(0), "B", 1, rule, ["nps_score"]).collect() == []


def test_a_failing_column_rule_costs_a_row_and_not_the_job(spark):
    own = [
        rul.Rule("R-1", 2, "a", lambda: F.col("x") / F.col("y") > 1, lambda: F.lit("ratio"), ("x", "y")),
        rul.Rule("R-2", 3, "b", lambda: F.col("x") > 0, lambda: F.concat(F.lit("n "), F.col("t").cast("int").cast("string")), ("x", "t")),
    ]
    data = spark.createDataFrame([("A", 4, 2, "7"), ("B", 4, 0, "x"), ("C", None, 0, "7"), ("D", 1, 2, "8")], "customer_id string, x int, y int, t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = {(r["customer_id"], r["rule_id"]): (r["action_type"], r["reason"], r["error"]) for r in rul.evaluate_rules_apart(data, own).collect()}
    assert got == {
        ("A", "R-1"): ("a", "ratio", None), ("A", "R-2"): ("b", "n 7", None), ("B", "R-1"): (None, None, "the condition cannot be computed"),
        ("B", "R-2"): (None, None, "the reason cannot be computed"), ("D", "R-2"): ("b", "n 8", None),
    }
    assert spark.conf.get("spark.sql.ansi.enabled") == before
