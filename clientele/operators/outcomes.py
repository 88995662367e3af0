"""Recording what became of an action, and reporting on it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions import as_timestamp, half_even
from clientele.operators.features import action_context
from clientele.operators.messages import render_messages
from clientele.operators.queue import MAX_LIMIT, pending_queue
from clientele.schemas import CLICKED_OUTCOMES, FAILURE_OUTCOMES, SUCCESS_OUTCOMES, UNOPENED_OUTCOMES
from clientele.session import stored


def outcome_class(outcome: Column) -> Column:
    """success, failure, or neutral for any other label and for none."""
    return (
        F.when(outcome.isin(*SUCCESS_OUTCOMES), "success").when(outcome.isin(*FAILURE_OUTCOMES), "failure")
        .otherwise("neutral")
    )


def email_flags(outcome: Column) -> tuple[Column, Column]:
    """Whether an email with this outcome counts as opened and as clicked, as 0 or 1."""
    opened = F.when(outcome.isin(*UNOPENED_OUTCOMES), 0).otherwise(1)
    clicked = F.when(outcome.isin(*CLICKED_OUTCOMES), 1).otherwise(0)
    return opened, clicked


def one_per_action(outcomes: DataFrame) -> DataFrame:
    """One outcome per action id, however many copies arrive; they merge map-side."""
    return outcomes.groupBy("action_id").agg(F.max("outcome").alias("outcome"))


def apply_outcomes(actions: DataFrame, outcomes: DataFrame, executed_at) -> DataFrame:
    """The action table after pending actions received their outcomes.

    Actions that are not pending, and outcomes of unknown actions, change nothing: the history passes by the join.
    """
    new = one_per_action(outcomes).select("action_id", F.col("outcome").alias("new_outcome"), F.lit(True).alias("has_outcome"))
    pending = F.col("status").eqNullSafe("pending")
    joined = actions.filter(pending).join(new, "action_id", "left")
    hit = F.coalesce("has_outcome", F.lit(False))
    changed = {
        "status": F.when(hit, "executed").otherwise(F.col("status")),
        "outcome": F.when(hit, F.col("new_outcome")).otherwise(F.col("outcome")),
        "executed_at": F.when(hit, as_timestamp(executed_at)).otherwise(F.col("executed_at")),
    }
    done = joined.select(*[changed.get(n, F.col(n)).alias(n) for n in actions.columns])
    return actions.filter(~pending).unionByName(done)


def execution_batch(
    tables: dict[str, DataFrame],
    outcomes: DataFrame,
    as_of,
    limit: int = 50,
    action_ids: Sequence[str] | None = None,
) -> DataFrame:
    """The most urgent pending actions with message, outcome and outcome class.

    No table is changed: the result is the dry run, and the input of the writers. The page itself is
    kept in the shared folder, as several joins read it. An action without a known outcome is ``completed``.
    """
    pending = tables["agent_actions"]
    if action_ids is not None:
        pending = pending.filter(F.col("action_id").isin(list(action_ids)))
    batch = stored(pending_queue(pending, limit), "page")
    small = limit <= MAX_LIMIT
    # The ids of a small page filter the large tables at their scan; larger pages join as Spark sees fit.
    sent = F.broadcast if small else (lambda df: df)
    ids = sent(batch.select("customer_id").distinct())
    people, scores = (
        tables[name].join(ids, "customer_id", "left_semi") for name in ("customers", "ml_predictions")
    )
    context = action_context(tables, batch, as_of, one_page=small)
    messages = render_messages(batch, people, scores, context, one_page=small)
    asked = outcomes.join(sent(batch.select("action_id")), "action_id", "left_semi")
    known = one_per_action(asked).select("action_id", F.col("outcome").alias("given"))
    label = F.coalesce("given", F.lit("completed"))
    return (
        messages.join(known, "action_id", "left")
        .withColumns(
            {
                "outcome": label,
                "outcome_class": outcome_class(label),
                "status": F.lit("executed"),
                "executed_at": as_timestamp(as_of),
            }
        )
        .drop("given")
    )


def email_log_rows(executed: DataFrame, prefix: str = "ACT-") -> DataFrame:
    """Log rows of the executed email actions; ids carry the full action id."""
    opened, clicked = email_flags(F.col("outcome"))
    return executed.filter("channel = 'email'").select(
        F.concat(F.lit(prefix), F.col("action_id")).alias("email_id"),
        "customer_id",
        F.col("action_type").alias("email_type"),
        "subject",
        opened.alias("opened"),
        clicked.alias("clicked"),
        F.col("executed_at").alias("sent_at"),
    )


def execution_report(executed: DataFrame) -> DataFrame:
    """Outcomes and success rate per action, and in total under the action ``ALL``.

    Rows are first counted per action and class; the total is rolled up from those.
    """
    counts = executed.groupBy("action_type", outcome_class(F.col("outcome")).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )

    def of(name):
        return F.sum(F.when(F.col("class") == name, F.col("n")).otherwise(0))

    rolled = counts.rollup("action_type").agg(
        F.grouping("action_type").alias("is_total"),
        F.sum("n").alias("total"), of("success").alias("success"), of("neutral").alias("neutral"),
        of("failure").alias("failure"),
    )
    shares = {
        f"{name}_rate": half_even(F.col(name) / F.greatest(F.col("total"), F.lit(1)), 4)
        for name in ("success", "neutral", "failure")
    }
    named = rolled.filter("total > 0").withColumn(
        "action_type", F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("action_type"))
    )
    # One row per kind of action: those with the most successes first, the total last.
    return named.withColumns(shares).orderBy("is_total", F.col("success").desc(), "action_type").drop("is_total")
