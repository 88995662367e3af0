"""Features from daily partial aggregates, without reading the history of the facts.

For each fact there is one row per customer and day (for events also per channel and type) with sums, counts and maxima, stored by month, as
a folder for each day would hold many small files. They merge by adding, so the features of any ``as_of`` are their sums. Late rows only rewrite the
months they fall on. The one window, of 30 days, may begin within a day: the events of that day alone are read again.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.functions import days_before, half_even
from clientele.operators import features as feat

RECENT_DAYS = 30
# Each fact's time column.
DAYS = {"transactions": "txn_date", "engagement_events": "event_date", "support_tickets": "opened_at", "email_log": "sent_at"}


def _count_if(condition):
    return F.count(F.when(condition, F.lit(1)))


def daily_partials(fact: str, rows: DataFrame) -> DataFrame:
    """The partial aggregates of a fact per customer and ``day``; rows without a customer are left out, a null time is a day of its own."""
    grouped = rows.filter(F.col("customer_id").isNotNull()).withColumn("day", F.to_date(DAYS[fact]))
    if fact == "transactions":
        return grouped.groupBy("day", "customer_id").agg(
            F.count("txn_id").alias("txn_count"), F.sum("amount").alias("total_spend"), F.count("amount").alias("amounts"),
            _count_if(F.col("status") == "refunded").alias("refund_count"), F.max("txn_date").alias("last_txn"),
        )
    if fact == "engagement_events":
        return grouped.groupBy("day", "customer_id", "channel", "event_type").agg(
            F.count("event_id").alias("events"), F.sum("session_duration").alias("seconds"),
            F.count("session_duration").alias("sessions"), F.max("event_date").alias("last_event"),
        )
    if fact == "support_tickets":
        return grouped.groupBy("day", "customer_id").agg(
            F.count("ticket_id").alias("ticket_count"), _count_if(F.col("status") == "open").alias("open_tickets"),
            _count_if(F.col("priority") == "critical").alias("critical_tickets"), F.sum("sentiment_score").alias("sentiment"),
            F.count("sentiment_score").alias("sentiments"), _count_if(F.col("topic") == "cancellation").alias("cancellation_risk"),
        )
    return grouped.groupBy("day", "customer_id").agg(
        F.count("email_id").alias("emails_sent"), F.sum("opened").alias("emails_opened"), F.sum("clicked").alias("emails_clicked"),
    )


def write_daily(tables: dict[str, DataFrame], path: str, days: Sequence[str] | None = None) -> None:
    """Write the partials of all days, or write the months of ``days`` (as text) anew: those that late rows, changed or removed ones fall on."""
    for fact, time in DAYS.items():
        rows, month = tables[fact], F.date_format("day", "yyyy-MM")
        if days is None:
            _by_month(daily_partials(fact, rows).withColumn("month", month)).parquet(f"{path}/{fact}")
            continue
        months = sorted({d[:7] for d in days})
        partials = daily_partials(fact, rows.filter(F.date_format(time, "yyyy-MM").isin(months))).withColumn("month", month)
        # A month that lost all its rows is written as well: a row without a customer stands for it.
        empty = rows.sparkSession.createDataFrame([(m,) for m in months], "month string")
        _by_month(partials.unionByName(empty, allowMissingColumns=True)).option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{fact}")


def _by_month(partials: DataFrame):
    """A writer of few files for each month; ranges split a month that is too large for one."""
    return partials.repartitionByRange("month", "customer_id").write.mode("overwrite").partitionBy("month")


def features_from_daily(spark: SparkSession, customers: DataFrame, events: DataFrame, path: str, as_of) -> DataFrame:
    """What ``build_customer_features`` gives, from the partials below ``path``; of ``events`` only the day on which the window begins is read."""
    known = {fact: spark.read.parquet(f"{path}/{fact}").filter("customer_id IS NOT NULL").drop("month") for fact in DAYS}
    start = days_before(as_of, RECENT_DAYS)
    transactions = known["transactions"].groupBy("customer_id").agg(
        F.sum("txn_count").alias("txn_count"), half_even(F.sum("total_spend"), 6).alias("total_spend"), F.sum("amounts").alias("amounts"),
        F.sum("refund_count").alias("refund_count"), F.max("last_txn").alias("last_txn"),
    )
    whole = known["engagement_events"].withColumn("recent", F.when(F.col("day") > start.cast("date"), F.col("events")).otherwise(0)).drop("day")
    first = events.filter((F.to_date("event_date") == start.cast("date")) & (F.col("event_date") >= start) & F.col("customer_id").isNotNull())
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    first = first.groupBy("customer_id", "channel", "event_type").agg(F.count("event_id").alias("recent")).withColumns(
        {"events": zero, "seconds": none.cast("bigint"), "sessions": zero, "last_event": none.cast("timestamp_ntz")}
    )
    tickets = known["support_tickets"].groupBy("customer_id").agg(
        *[F.sum(n).alias(n) for n in ("ticket_count", "open_tickets", "critical_tickets")],
        half_even(F.sum("sentiment"), 6).alias("sentiment"), F.sum("sentiments").alias("sentiments"), F.sum("cancellation_risk").alias("cancellation_risk"),
    )
    emails = known["email_log"].groupBy("customer_id").agg(*[F.sum(n).alias(n) for n in ("emails_sent", "emails_opened", "emails_clicked")])
    return feat.finished_features(feat.feature_join(
        feat.customer_base(customers, as_of),
        feat.finished_txn(transactions, as_of),
        feat.finished_engagement(whole.unionByName(first), as_of),
        feat.finished_tickets(tickets),
        feat.finished_emails(emails),
    ))
