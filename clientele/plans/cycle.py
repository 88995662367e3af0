"""One decision cycle: features, scores, rules, plans and queue."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators.features import build_customer_features
from clientele.operators.queue import cooldown_pairs, queue_rows, with_cooling
from clientele.operators.rules import enrich, fire_rules
from clientele.operators.scoring import one_row
from clientele.plans.planner import fired_sets, resolve_plans
from clientele.session import stored


@dataclass(frozen=True)
class Cycle:
    """The frames of one cycle; ``plans`` tell with ``cooling`` which of them are not queued."""

    customers: DataFrame
    sets: DataFrame
    plans: DataFrame
    queue: DataFrame


def decision_cycle(
    tables: dict[str, DataFrame],
    as_of,
    responses: DataFrame | None = None,
    budget: int = 20,
    materialise: bool = True,
    queue_as_of=None,
) -> Cycle:
    """From the tables to the queue.

    The rules, the planning and the urgency run in the partitions of the feature
    join: after it only the cooldown join shuffles. ``materialise`` writes the fired
    sets and the plans to the shared folder, so that several readers of the cycle, or a retry
    after lost executors, do not build the features again. ``queue_as_of`` is the time of the cooldown and of
    the queued rows, if it differs from that of the features.
    """
    features = build_customer_features(tables, as_of)
    sets = fired_sets(fire_rules(enrich(features, tables["ml_predictions"])))
    if materialise:
        sets = stored(sets, "fired-sets")
    start = queue_as_of or as_of
    plans = with_cooling(resolve_plans(sets, responses, budget), cooldown_pairs(tables["agent_actions"], start))
    if materialise:
        plans = stored(plans, "plans")
    queue = queue_rows(plans.filter("NOT cooling").drop("cooling"), start)
    return Cycle(tables["customers"], sets, plans, queue)


def cycle_summary(cycle: Cycle, as_of) -> DataFrame:
    """One row: customers, candidates, plans, queued, skipped, enhanced, critical and high."""
    count = F.count(F.lit(1))
    summary = one_row(
        cycle.customers.agg(count.alias("customers")),
        cycle.sets.agg(F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("candidates")),
        cycle.plans.agg(
            count.alias("plans"),
            F.count(F.when(F.col("llm_enhanced"), 1)).alias("llm_enhanced"),
            F.count(F.when(~F.col("cooling"), 1)).alias("queued_actions"),
            F.count(F.when(~F.col("cooling") & (F.col("priority") == 5), 1)).alias("critical"),
            F.count(F.when(~F.col("cooling") & (F.col("priority") == 4), 1)).alias("high"),
        ),
    )
    return summary.withColumns(
        {
            "cooldown_skipped": F.col("plans") - F.col("queued_actions"),
            "cycle_at": F.lit(str(as_of)),
        }
    )
