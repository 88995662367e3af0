"""Cooldown, urgency and the queue of pending actions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions import as_timestamp, days_before, literal_map, whole_days
from clientele.operators.pages import ONE_TASK_ROWS, first_rows
from clientele.schemas import COOLDOWN_DAYS, COOLDOWN_HORIZON_DAYS, DEFAULT_COOLDOWN_DAYS, TABLES
from clientele.sources.tables import latest_predictions

MAX_LIMIT = 500
MAX_OFFSET = 10_000


def checked_limit(limit: int, offset: int = 0) -> int:
    """Report pages are small by contract, so a page always fits one task; deeper ones continue after a key."""
    if not 0 <= limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"limit must be between 0 and {MAX_LIMIT}, offset between 0 and {MAX_OFFSET}")
    return limit


def cooldown_pairs(actions: DataFrame, as_of) -> DataFrame:
    """Distinct (customer, action) pairs that were executed too recently to repeat.

    Only the newest execution of a pair matters, so repeats merge before the shuffle.
    """
    recent = actions.filter(
        (F.col("status") == "executed") & (F.col("executed_at") >= days_before(as_of, COOLDOWN_HORIZON_DAYS))
    )
    newest = recent.groupBy("customer_id", "action_type").agg(F.max("executed_at").alias("newest"))
    days = F.coalesce(literal_map(COOLDOWN_DAYS, F.col("action_type")), F.lit(DEFAULT_COOLDOWN_DAYS))
    return newest.filter(whole_days(F.col("newest"), as_of) < days).select("customer_id", "action_type")


def drop_cooling(plans: DataFrame, pairs: DataFrame) -> DataFrame:
    return plans.join(pairs, ["customer_id", "action_type"], "left_anti")


def urgency_score(priority: Column, confidence: Column, ltv: Column) -> Column:
    """3 per priority step, 1.5 for full confidence, up to 2 for a lifetime value of 2000."""
    known = F.coalesce(F.nanvl(ltv, F.lit(None).cast("double")), F.lit(0.0))
    return priority * 3.0 + confidence * 1.5 + F.least(known / 2000.0, F.lit(1.0)) * 2.0


def attach_ltv(plans: DataFrame, predictions: DataFrame) -> DataFrame:
    """Plans with the lifetime value that the urgency needs, where they do not carry it yet."""
    if "ltv_estimate" in plans.columns:
        return plans
    return plans.join(latest_predictions(predictions).select("customer_id", "ltv_estimate"), "customer_id", "left")


def with_cooling(plans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Plans with ``cooling``: whether their action was executed too recently for their customer."""
    marked = pairs.withColumn("cooling", F.lit(True))
    joined = plans.join(marked, ["customer_id", "action_type"], "left")
    return joined.withColumn("cooling", F.coalesce("cooling", F.lit(False)))


def build_queue(plans: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Pending action rows of the plans that are not in cooldown."""
    return queue_rows(drop_cooling(plans, cooldown_pairs(actions, as_of)), as_of)


def queue_rows(ready: DataFrame, as_of) -> DataFrame:
    """Pending action rows of plans.

    ``ready`` plans carry ``ltv_estimate``. Rows come unsorted: :func:`pending_queue` reads
    the most urgent ones without sorting the whole table. Ids repeat on a rerun.
    """
    now = as_timestamp(as_of)
    key = F.concat_ws("|", "customer_id", "action_type", now.cast("string"))
    rows = {
        "action_id": F.sha2(key, 256),
        "status": F.lit("pending"),
        "outcome": F.lit(None),
        "created_at": now,
        "executed_at": F.lit(None),
        "feedback_applied_at": F.lit(None),
        "urgency_score": urgency_score(F.col("priority"), F.col("confidence"), F.col("ltv_estimate")),
    }
    return ready.select(
        *[
            rows.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in TABLES["agent_actions"].fields
        ]
    )


def _most_urgent(rows: DataFrame, limit: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    order = [
        F.col("urgency_score").desc_nulls_last(),
        F.col("priority").desc_nulls_last(),
        F.col("created_at").asc_nulls_first(),
        F.col("action_id").asc(),
    ]
    return first_rows(rows, order, limit, "urgency_score", one_task_rows)


def action_queue(
    actions: DataFrame, status: str = "pending", priority: int | None = None, limit: int = 50
) -> DataFrame:
    """The most urgent actions of a status; priority 0 or None means any."""
    rows = actions.filter(F.col("status") == status)
    if priority:
        rows = rows.filter(F.col("priority") == priority)
    return _most_urgent(rows, checked_limit(limit))


def pending_queue(actions: DataFrame, limit: int = 100, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The most urgent pending actions, as many as asked for; in order up to ``one_task_rows`` of them."""
    return _most_urgent(actions.filter("status = 'pending'"), limit, one_task_rows)


def queue_priorities(queue: DataFrame) -> DataFrame:
    """Queued actions per priority."""
    return queue.groupBy("priority").agg(F.count(F.lit(1)).alias("queued"))
