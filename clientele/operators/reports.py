"""The read queries: KPIs, rankings, segments and the action table.

Every ranking ends in ``orderBy(...).limit(...)``, which Spark runs as a top-k per
partition; ties are broken by id so that a page is the same on every run.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.functions import half_even
from clientele.operators.queue import checked_limit
from clientele.operators.scoring import conversion_band, one_row, risk_band
from clientele.schemas import PLANS


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _total(amount: Column, digits: int = 2) -> Column:
    return F.coalesce(half_even(F.sum(amount), digits), F.lit(0.0))


def kpi_summary(customers: DataFrame, predictions: DataFrame, actions: DataFrame) -> DataFrame:
    """One row of headline figures, from one pass over each table."""
    active = F.col("is_churned") == 0
    people = customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        _count_if(active).alias("active_customers"),
        _total(F.when(active, F.col("mrr"))).alias("total_mrr"),
    )
    scores = predictions.agg(
        _total(F.col("ltv_estimate")).alias("total_ltv"),
        _count_if(F.col("churn_score") >= 0.6).alias("high_risk_count"),
        _count_if(F.col("conversion_score") >= 0.7).alias("hot_conversions"),
    )
    work = actions.agg(
        _count_if(F.col("status") == "executed").alias("actions_executed"),
        _count_if(F.col("status") == "pending").alias("actions_pending"),
    )
    churned = F.col("total_customers") - F.col("active_customers")
    rate = half_even(churned / F.greatest(F.col("total_customers"), F.lit(1)) * 100.0, 2)
    return one_row(people, scores, work).withColumns({"churned_customers": churned, "churn_rate": rate})


def segment_counts(predictions: DataFrame) -> DataFrame:
    """Customers, share and mean churn of each segment (the window sees one row per segment)."""
    counts = predictions.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), half_even(F.avg("churn_score"), 2).alias("avg_churn")
    )
    share = F.col("customers") * 100.0 / F.sum("customers").over(W.partitionBy())
    return counts.withColumn("share_pct", half_even(share, 2)).orderBy(F.col("customers").desc(), "segment")


_PROFILE = ("customer_id", "name", "plan", "mrr", "health_score")
_SCORES = ("churn_score", "conversion_score", "segment", "ltv_estimate")


def list_customers(
    customers: DataFrame,
    predictions: DataFrame,
    plan: str | None = None,
    segment: str | None = None,
    min_churn: float = 0.0,
    max_churn: float = 1.0,
    limit: int = 50,
    offset: int = 0,
    after: tuple[float, str] | None = None,
) -> DataFrame:
    """A page of active customers with their scores, most likely to leave first.

    ``after`` is the (churn_score, customer_id) of the last row seen: any page costs as much as the first.
    """
    checked_limit(limit, offset)
    people = customers.filter("is_churned = 0")
    scores = predictions.filter(F.col("churn_score").between(min_churn, max_churn))
    if plan:
        people = people.filter(F.col("plan") == plan)
    if segment:
        scores = scores.filter(F.col("segment") == segment)
    if after is not None:
        score, last = after
        scores = scores.filter((F.col("churn_score") < score) | (F.col("churn_score") == score) & (F.col("customer_id") > last))
    rows = people.select(*_PROFILE).join(scores.select("customer_id", *_SCORES), "customer_id")
    return rows.orderBy(F.col("churn_score").desc(), "customer_id").offset(offset).limit(limit)


def risk_profiles(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Profile, scores and report bands of every scored customer."""
    rows = customers.select(*_PROFILE).join(
        predictions.select("customer_id", *_SCORES, "predicted_at"), "customer_id"
    )
    return rows.withColumns(
        {
            "churn_risk": risk_band(F.col("churn_score")),
            "conversion_tier": conversion_band(F.col("conversion_score")),
        }
    )


def customer_risk(customers: DataFrame, predictions: DataFrame, customer_id: str) -> DataFrame:
    """The risk profile of one customer; no row if unknown. The filter reaches both scans."""
    return risk_profiles(customers, predictions).filter(F.col("customer_id") == customer_id)


def customer_actions(actions: DataFrame, customer_id: str) -> DataFrame:
    """All actions of a customer, newest first."""
    return actions.filter(F.col("customer_id") == customer_id).orderBy(
        F.col("created_at").desc_nulls_last(), "action_id"
    )


def suggested_label(score: Column) -> Column:
    """What the dashboard proposes for a churn score."""
    return (
        F.when(score > 0.4, "escalate_to_csm").when(score > 0.3, "send_retention_email")
        .otherwise("send_health_checkin")
    )


def churn_ranking(
    customers: DataFrame, predictions: DataFrame, min_score: float = 0.0, limit: int = 50, labels: bool = False
) -> DataFrame:
    """Active customers by churn score, highest first."""
    checked_limit(limit)
    people = customers.filter("is_churned = 0").select("customer_id", "name", "plan", "mrr")
    scores = predictions.filter(F.col("churn_score") >= min_score).select(
        "customer_id", "churn_score", "segment", "ltv_estimate"
    )
    top = people.join(scores, "customer_id").orderBy(F.col("churn_score").desc(), "customer_id").limit(limit)
    return top.withColumn("suggested_action", suggested_label(F.col("churn_score"))) if labels else top


def conversion_ranking(
    customers: DataFrame, predictions: DataFrame, min_score: float = 0.5, limit: int = 50
) -> DataFrame:
    """Customers below Enterprise by conversion score; churned ones stay in."""
    checked_limit(limit)
    people = customers.filter("plan <> 'Enterprise'").select("customer_id", "name", "plan", "mrr")
    scores = predictions.filter(F.col("conversion_score") >= min_score).select(
        "customer_id", "conversion_score", "segment"
    )
    return people.join(scores, "customer_id").orderBy(F.col("conversion_score").desc(), "customer_id").limit(limit)


def segment_metrics(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Mean scores, price and total lifetime value per segment, most endangered first."""
    rows = predictions.select("customer_id", *_SCORES).join(customers.select("customer_id", "mrr"), "customer_id")
    return (
        rows.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            half_even(F.avg("churn_score"), 3).alias("avg_churn_score"),
            half_even(F.avg("conversion_score"), 3).alias("avg_conversion_score"),
            half_even(F.avg("mrr"), 2).alias("avg_mrr"),
            half_even(F.sum("ltv_estimate"), 2).alias("total_ltv"),
        )
        .orderBy(F.col("avg_churn_score").desc(), "segment")
    )


def action_by_id(actions: DataFrame, action_id: str) -> DataFrame:
    return actions.filter(F.col("action_id") == action_id)


def latest_executed(actions: DataFrame, limit: int = 6) -> DataFrame:
    """The newest executed actions; equal times are ordered by id, newest id first."""
    return (
        actions.filter("status = 'executed'")
        .select("action_id", "customer_id", "action_type", "priority", "outcome", "executed_at")
        .orderBy(F.col("executed_at").desc_nulls_last(), F.col("action_id").desc())
        .limit(checked_limit(limit))
    )


def data_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Volumes as (metric, value) rows: tables, churned and active customers, plans, active MRR."""
    active = F.col("is_churned") == 0
    people = tables["customers"].agg(
        F.count(F.lit(1)).alias("customers"),
        _count_if(F.col("is_churned") == 1).alias("churned"),
        _count_if(active).alias("active"),
        _total(F.when(active, F.col("mrr"))).alias("active_mrr"),
        half_even(F.avg("is_churned"), 4).alias("churn_rate"),
        *[_count_if(F.col("plan") == plan).alias(f"plan_{plan}") for plan in PLANS],
    )
    facts = [
        tables[name].agg(F.count(F.lit(1)).alias(name))
        for name in ("transactions", "engagement_events", "support_tickets", "email_log")
    ]
    row = one_row(people, *facts)
    return row.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in row.columns])
        )
    )


def churn_band_distribution(predictions: DataFrame) -> DataFrame:
    """Customers per churn band of the dashboard."""
    band = (
        F.when(F.col("churn_score") < 0.3, "<30%").when(F.col("churn_score") <= 0.6, "30-60%").otherwise(">60%")
    )
    return predictions.filter("churn_score IS NOT NULL").groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("customers")
    )


def outcome_distribution(actions: DataFrame) -> DataFrame:
    """Executed actions per outcome, most frequent first."""
    return (
        actions.filter("status = 'executed'").groupBy("outcome").agg(F.count(F.lit(1)).alias("actions"))
        .orderBy(F.col("actions").desc(), F.col("outcome").asc_nulls_last())
    )
