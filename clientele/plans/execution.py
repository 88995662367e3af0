"""Executing a page of the queue, and feeding its outcomes back, on stored tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clientele.operators.feedback import apply_health, pending_feedback, without_logged
from clientele.operators.outcomes import email_log_rows, execution_batch
from clientele.sources import sinks


def run_execution(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    outcomes: DataFrame,
    as_of,
    actions_path: str,
    email_path: str,
    staging: str,
    limit: int = 50,
) -> DataFrame:
    """Execute the most urgent actions of the stored table, commit their outcomes and log the mails.

    Returns the executed rows with messages, for :func:`execution_report`. Run it
    again with the same ``staging`` to finish an attempt that failed.
    """
    current = {**tables, "agent_actions": sinks.read_actions(spark, actions_path)}
    batch = execution_batch(current, outcomes, as_of, limit)
    committed = sinks.commit_outcomes(spark, actions_path, batch, staging)
    sinks.append_email_log(spark, email_log_rows(committed), email_path)
    return committed


@dataclass(frozen=True)
class Feedback:
    """A feedback run: the outcomes it applied, and the customers after them."""

    batch: DataFrame
    customers: DataFrame


def run_feedback(
    spark: SparkSession,
    customers: DataFrame,
    actions: DataFrame,
    as_of,
    log_path: str,
    staging: str,
    hours: int = 24,
) -> Feedback:
    """Fold the outcomes that no earlier run applied into the health scores.

    The batch and the new customers are kept in ``staging``, which belongs to this
    run, before the batch is logged as applied; a repeated attempt returns the same.
    """
    recent = pending_feedback(actions, as_of, hours)
    batch = sinks.write_once(
        without_logged(recent, sinks.read_feedback_log(spark, log_path), as_of, hours), f"{staging}/batch"
    )
    people = sinks.write_once(apply_health(customers, batch), f"{staging}/customers")
    sinks.append_feedback_log(spark, batch, as_of, log_path)
    return Feedback(batch, people)
