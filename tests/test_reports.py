from clientele.operators import reports as rep
from clientele.sources.driver_tables import crm_tables
from tests.conftest import SF_DIR


def test_headline_figures_add_up(spark):
    t = crm_tables(spark, SF_DIR)
    row = rep.kpi_summary(t["customers"], t["ml_predictions"], t["agent_actions"]).first()
    assert row["total_customers"] == row["active_customers"] + row["churned_customers"]
    assert row["actions_executed"] + row["actions_pending"] == t["agent_actions"].count()


def test_headline_figures_of_empty_tables(spark, frame):
    row = rep.kpi_summary(frame("customers", []), frame("ml_predictions", []), frame("agent_actions", [])).first().asDict()
    assert all(v == 0 for v in row.values())


def test_rankings_descend(spark):
    t = crm_tables(spark, SF_DIR)
    for df, column in (
        (rep.churn_ranking(t["customers"], t["ml_predictions"]), "churn_score"),
        (rep.conversion_ranking(t["customers"], t["ml_predictions"]), "conversion_score"),
        (rep.list_customers(t["customers"], t["ml_predictions"]), "churn_score"),
    ):
        values = [r[column] for r in df.collect()]
        assert values == sorted(values, reverse=True) and len(values) == 50
        assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_pages_do_not_overlap(spark):
    t = crm_tables(spark, SF_DIR)
    pages = [rep.list_customers(t["customers"], t["ml_predictions"], limit=10, offset=o).collect() for o in (0, 10)]
    ids = [[r["customer_id"] for r in page] for page in pages]
    assert len(set(ids[0]) | set(ids[1])) == 20


def test_unknown_ids_give_no_row(spark):
    t = crm_tables(spark, SF_DIR)
    assert rep.customer_risk(t["customers"], t["ml_predictions"], "nobody").count() == 0
    assert rep.action_by_id(t["agent_actions"], "nothing").count() == 0


def test_shares_sum_to_hundred(spark):
    t = crm_tables(spark, SF_DIR)
    assert abs(sum(r["share_pct"] for r in rep.segment_counts(t["ml_predictions"]).collect()) - 100) < 0.05


def test_plan_breakdown_lists_unused_plans(spark, frame):
    tables = {n: frame(n, []) for n in ("transactions", "engagement_events", "support_tickets", "email_log")}
    tables["customers"] = frame("customers", [dict(customer_id="A", plan="Pro", is_churned=0, mrr=5.0)])
    got = {r["metric"]: r["value"] for r in rep.data_summary(tables).collect()}
    assert got["plan_Pro"] == 1 and got["plan_Free"] == 0 and got["active_mrr"] == 5.0
