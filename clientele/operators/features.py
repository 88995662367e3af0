"""One feature row per customer.

Each fact table is aggregated on its own with map-side partials, so a customer
that owns a large part of a table reaches the shuffle as one row per task. The
joins then see at most one row per customer on either side.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions import clamp, days_before, half_even, stable_sum, whole_days
from clientele.schemas import PLANS

# The model features by group; this order is the vector order.
FEATURE_CATALOG: dict[str, tuple[str, ...]] = {
    "customer": ("tenure_days", "plan_rank", "mrr", "nps_score", "health_score", "employee_count"),
    "transaction": ("txn_count", "total_spend", "avg_order_value", "refund_rate", "last_txn_days_ago"),
    "engagement": (
        "event_count_total", "event_count_30d", "avg_session_sec", "unique_channels",
        "unique_event_types", "days_since_last_event", "recency_score", "engagement_index",
    ),
    "support": (
        "ticket_count", "open_tickets", "critical_tickets", "avg_sentiment", "cancellation_risk",
        "unresolved_rate",
    ),
    "email": ("open_rate", "click_rate"),
    "derived": ("risk_index",),
}


def feature_columns() -> list[str]:
    return [name for group in FEATURE_CATALOG.values() for name in group]


def _per_customer(fact: DataFrame):
    """Facts without a customer count for nobody."""
    return fact.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")


def _count_if(condition):
    return F.count(F.when(condition, F.lit(1)))


def _ratio(part: str, whole: str):
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def customer_base(customers: DataFrame, as_of) -> DataFrame:
    """Customers with whole tenure days and the rank of their plan (unknown plan: null)."""
    rank = F.lit(None).cast("int")
    for position, plan in reversed(list(enumerate(PLANS))):
        rank = F.when(F.col("plan") == plan, F.lit(position)).otherwise(rank)
    return customers.withColumns(
        {"tenure_days": whole_days(F.col("signup_date"), as_of), "plan_rank": rank}
    )


def txn_features(transactions: DataFrame, as_of) -> DataFrame:
    """Spend counts every status; refunds lower it by their negative amount."""
    sums = _per_customer(transactions).agg(
        F.count("txn_id").alias("txn_count"),
        stable_sum(F.col("amount")).alias("total_spend"),
        F.count("amount").alias("amounts"),
        _count_if(F.col("status") == "refunded").alias("refund_count"),
        F.max("txn_date").alias("last_txn"),
    )
    return finished_txn(sums, as_of)


def finished_txn(sums: DataFrame, as_of) -> DataFrame:
    """Spend features of a customer's txn_count, total_spend, amounts, refund_count and last_txn."""
    return sums.select(
        "customer_id",
        "txn_count",
        "total_spend",
        (F.col("total_spend") / F.nullif(F.col("amounts"), F.lit(0))).alias("avg_order_value"),
        "refund_count",
        whole_days(F.col("last_txn"), as_of).alias("last_txn_days_ago"),
        _ratio("refund_count", "txn_count").alias("refund_rate"),
    )


def engagement_features(events: DataFrame, as_of) -> DataFrame:
    """Activity counts; the 30-day window includes its first instant.

    Events are first counted per customer, channel and type. The exact distinct
    counts, for which Spark triples its input, then run on those few rows, and
    their state does not grow with a customer's events.
    """
    recent = F.col("event_date") >= days_before(as_of, 30)
    kinds = (
        events.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "channel", "event_type")
        .agg(
            F.count("event_id").alias("events"),
            _count_if(recent).alias("recent"),
            F.sum("session_duration").alias("seconds"),
            F.count("session_duration").alias("sessions"),
            F.max("event_date").alias("last_event"),
        )
    )
    return finished_engagement(kinds, as_of)


def finished_engagement(kinds: DataFrame, as_of) -> DataFrame:
    """Activity features of counts per customer, channel and type (any number of rows for each): events, recent, seconds, sessions, last_event."""
    sums = kinds.groupBy("customer_id").agg(
        F.sum("events").alias("event_count_total"),
        F.sum("recent").alias("event_count_30d"),
        (F.sum("seconds") / F.nullif(F.sum("sessions"), F.lit(0))).alias("avg_session_sec"),
        F.count_distinct("channel").alias("unique_channels"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.max("last_event").alias("last_event"),
    )
    return sums.withColumn(
        "days_since_last_event", whole_days(F.col("last_event"), as_of)
    ).drop("last_event")


def ticket_features(tickets: DataFrame) -> DataFrame:
    """Ticket counts; only the status ``open`` counts as open."""
    sums = _per_customer(tickets).agg(
        F.count("ticket_id").alias("ticket_count"),
        _count_if(F.col("status") == "open").alias("open_tickets"),
        _count_if(F.col("priority") == "critical").alias("critical_tickets"),
        stable_sum(F.col("sentiment_score")).alias("sentiment"),
        F.count("sentiment_score").alias("sentiments"),
        _count_if(F.col("topic") == "cancellation").alias("cancellation_risk"),
    )
    return finished_tickets(sums)


def finished_tickets(sums: DataFrame) -> DataFrame:
    """Ticket features of a customer's ticket_count, open_tickets, critical_tickets, sentiment, sentiments and cancellation_risk."""
    sums = sums.select(
        "customer_id", "ticket_count", "open_tickets", "critical_tickets",
        (F.col("sentiment") / F.nullif(F.col("sentiments"), F.lit(0))).alias("avg_sentiment"), "cancellation_risk",
    )
    return sums.withColumn("unresolved_rate", _ratio("open_tickets", "ticket_count"))


def email_features(emails: DataFrame) -> DataFrame:
    sums = _per_customer(emails).agg(
        F.count("email_id").alias("emails_sent"),
        F.sum("opened").alias("emails_opened"),
        F.sum("clicked").alias("emails_clicked"),
    )
    return finished_emails(sums)


def finished_emails(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "open_rate": _ratio("emails_opened", "emails_sent"),
            "click_rate": _ratio("emails_clicked", "emails_sent"),
        }
    )


def feature_join(base: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """Customers with each aggregate attached; all joins share the one key."""
    for aggregate in aggregates:
        base = base.join(aggregate, "customer_id", "left")
    return base


def fill_numeric(df: DataFrame) -> DataFrame:
    """Every numeric null becomes 0; texts and times stay."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(0, subset=numeric)


def recency_score(days):
    """100 on the day of the last event, then 1.5 less for each day, not below 0."""
    return 100.0 - clamp(days * 1.5, 0.0, 100.0)


def engagement_index():
    return half_even(
        F.col("event_count_30d") * 2
        + F.col("avg_session_sec") / 60.0
        + F.col("open_rate") * 10
        + F.col("click_rate") * 20,
        2,
    )


def risk_index():
    return half_even(
        F.col("cancellation_risk") * 20
        + F.col("critical_tickets") * 10
        + F.col("unresolved_rate") * 15
        + F.col("refund_rate") * 10,
        2,
    )


def build_customer_features(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """All customer columns and features, one row per customer.

    A customer without any activity gets 0 everywhere, also in
    ``days_since_last_event``; ``has_events`` tells the two kinds of 0 apart.
    """
    return finished_features(feature_join(
        customer_base(tables["customers"], as_of),
        txn_features(tables["transactions"], as_of),
        engagement_features(tables["engagement_events"], as_of),
        ticket_features(tables["support_tickets"]),
        email_features(tables["email_log"]),
    ))


def finished_features(joined: DataFrame) -> DataFrame:
    """Nulls filled and the indexes added, once all aggregates are joined."""
    flagged = joined.withColumn("has_events", F.col("event_count_total").isNotNull())
    return fill_numeric(flagged).withColumns(
        {
            "recency_score": recency_score(F.col("days_since_last_event")),
            "engagement_index": engagement_index(),
            "risk_index": risk_index(),
        }
    )


def feature_profile(features: DataFrame) -> DataFrame:
    """Group, place, mean and maximum of each model feature over all customers, in one pass."""
    names = feature_columns()
    cells = [
        F.struct(
            F.lit(group).alias("feature_group"),
            F.lit(names.index(name)).alias("place"),
            F.lit(name).alias("feature"),
            F.col(f"mean_{name}").alias("mean"),
            F.col(f"max_{name}").alias("max"),
        )
        for group, members in FEATURE_CATALOG.items()
        for name in members
    ]
    sums = features.agg(
        *[F.avg(F.col(n).cast("double")).alias(f"mean_{n}") for n in names],
        *[F.max(F.col(n).cast("double")).alias(f"max_{n}") for n in names],
    )
    return sums.select(F.inline(F.array(*cells)))


def action_context(tables: dict[str, DataFrame], ids: DataFrame, as_of, one_page: bool = False) -> DataFrame:
    """What a message needs to know about the customers in ``ids``.

    ``avg_sentiment`` covers open tickets only. ``open_tickets_fanout`` is the count
    a join of tickets with events gives, where every event repeats each ticket.

    Facts are aggregated before they meet ``ids``, so a customer with very many of
    them is merged map-side. ``one_page`` states that ``ids`` come from a queue page
    (500 rows at most): those are broadcast to filter the facts at their scan.
    """
    wanted = ids.select("customer_id").distinct()
    events = tables["engagement_events"].filter(F.col("customer_id").isNotNull())
    tickets = tables["support_tickets"].filter("status = 'open' AND customer_id IS NOT NULL")
    if one_page:
        wanted = F.broadcast(wanted)
        events = events.join(wanted, "customer_id", "left_semi")
        tickets = tickets.join(wanted, "customer_id", "left_semi")
    last = events.groupBy("customer_id").agg(
        F.max("event_date").alias("last_event"), F.count("event_id").alias("events")
    )
    open_now = tickets.groupBy("customer_id").agg(
        F.count("ticket_id").alias("open_now"),
        (stable_sum(F.col("sentiment_score")) / F.nullif(F.count("sentiment_score"), F.lit(0))).alias("sentiment"),
    )
    rows = (
        tables["customers"].join(wanted, "customer_id", "left_semi")
        .select("customer_id", "signup_date")
        .join(last, "customer_id", "left")
        .join(open_now, "customer_id", "left")
    )
    zero = F.lit(0)
    open_tickets = F.coalesce(F.col("open_now"), zero)
    return rows.select(
        "customer_id",
        F.coalesce(whole_days(F.col("last_event"), as_of, toward_zero=True), zero).alias("days_since_last_event"),
        open_tickets.alias("open_tickets"),
        (open_tickets * F.greatest(F.coalesce(F.col("events"), zero), F.lit(1))).alias("open_tickets_fanout"),
        F.coalesce(F.col("sentiment"), F.lit(0.0)).alias("avg_sentiment"),
        F.coalesce(whole_days(F.col("signup_date"), as_of, toward_zero=True), zero).alias("tenure_days"),
    )
