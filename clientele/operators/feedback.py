"""Fold outcomes into health scores, each one once and in order.

One outcome moves health by a delta and clamps it to [0, 100]. Such steps compose:
any run of them is again "add ``shift``, then clamp to [``floor``, ``ceiling``]". So
a customer's outcomes can be folded in slices, wherever the slices are, and the
slices folded afterwards; a customer with very many outcomes never has to fit one
task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions import as_timestamp, hours_before, literal_map
from clientele.schemas import HEALTH_DELTAS

LOW, HIGH = 0.0, 100.0
# Each level makes one step of up to so many; the last fold then has a few steps per customer and partition.
FOLD_ROWS, FOLD_LEVELS = 10_000, 2


def pending_feedback(actions: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Executed actions of the last hours whose outcome has not been applied yet."""
    return actions.filter(
        (F.col("status") == "executed")
        & (F.col("executed_at") >= hours_before(as_of, hours))
        & F.col("feedback_applied_at").isNull()
    )


def without_logged(batch: DataFrame, log: DataFrame, as_of=None, hours: int | None = None) -> DataFrame:
    """The batch without the actions that a feedback log notes as applied.

    ``as_of`` and ``hours`` are those of the batch: only that part of the log is read, as the log notes when an action was executed.
    """
    if hours is not None:
        log = log.filter(F.col("executed_at") >= hours_before(as_of, hours))
    return batch.join(log.select("action_id"), "action_id", "left_anti").select(*batch.columns)


def health_delta(outcome: Column) -> Column:
    """Health change of an outcome; unknown labels and none change nothing."""
    return F.coalesce(literal_map(HEALTH_DELTAS, outcome), F.lit(0.0))


def _limited(x: Column, floor: Column, ceiling: Column) -> Column:
    return F.least(ceiling, F.greatest(floor, x))


def composed(steps: Column) -> Column:
    """One step that does what the steps of an array do one after the other."""
    start = F.struct(
        F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("floor"), F.lit(float("inf")).alias("ceiling")
    )
    return F.aggregate(
        steps,
        start,
        lambda done, step: F.struct(
            (done["shift"] + step["shift"]).alias("shift"),
            _limited(done["floor"] + step["shift"], step["floor"], step["ceiling"]).alias("floor"),
            _limited(done["ceiling"] + step["shift"], step["floor"], step["ceiling"]).alias("ceiling"),
        ),
    )


def fold_steps(
    steps: DataFrame, order: tuple[str, ...], slices: int | None = None, keys: tuple[str, ...] = ("customer_id",)
) -> DataFrame:
    """One combined step per key from ``shift``, ``floor``, ``ceiling`` rows.

    Rows are range-partitioned by key and order, which also splits the rows of one large customer, and numbered
    in that order. Runs of at most FOLD_ROWS numbers are folded, then runs of those, so no array is longer
    than that, whatever the size of a partition or a customer.
    """
    ranged = steps.repartitionByRange(*((slices,) if slices else ()), *keys, *order).sortWithinPartitions(*keys, *order)
    folded = ranged.select(*keys, F.monotonically_increasing_id().alias("place"), "shift", "floor", "ceiling")
    run = F.array_sort(F.collect_list(F.struct("place", "shift", "floor", "ceiling"))).alias("run")
    for _ in range(FOLD_LEVELS):
        grouped = folded.groupBy(*keys, F.expr(f"place DIV {FOLD_ROWS}").alias("next")).agg(run)
        folded = grouped.select(*keys, F.col("next").alias("place"), composed(F.col("run")).alias("step"))
        folded = folded.select(*keys, "place", "step.*")
    whole = folded.groupBy(*keys).agg(run).select(*keys, composed(F.col("run")).alias("step"))
    return whole.select(*keys, "step.*")


def health_steps(batch: DataFrame, slices: int | None = None, keys: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """The combined health step of each key; ties in time are ordered by action id."""
    delta = health_delta(F.col("outcome"))
    steps = batch.filter((delta != 0) & F.col("customer_id").isNotNull()).select(
        *keys, "executed_at", "action_id",
        delta.alias("shift"), F.lit(LOW).alias("floor"), F.lit(HIGH).alias("ceiling"),
    )
    return fold_steps(steps, ("executed_at", "action_id"), slices, keys)


def moved_health(health: Column) -> Column:
    """Health after the step columns next to it; an unknown health, or no step, stays as it is."""
    moved = _limited(health + F.col("shift"), F.col("floor"), F.col("ceiling"))
    return F.when(health.isNull() | F.col("shift").isNull(), health).otherwise(moved)


def apply_health(customers: DataFrame, batch: DataFrame) -> DataFrame:
    """Customers with the batch folded into ``health_score``, in order of execution."""
    return apply_steps(customers, health_steps(batch))


def apply_steps(customers: DataFrame, steps: DataFrame) -> DataFrame:
    """Customers with one combined step each applied to ``health_score``."""
    joined = customers.join(steps, "customer_id", "left")
    return joined.select(
        *[moved_health(F.col(n)).alias(n) if n == "health_score" else F.col(n) for n in customers.columns]
    )


def mark_applied(actions: DataFrame, batch: DataFrame, applied_at) -> DataFrame:
    """The action table with every row of the batch marked, also those that changed nothing.

    Only executed actions without a mark can be in a batch: the others pass by the join.
    """
    open_ = (F.col("status") == "executed") & F.col("feedback_applied_at").isNull()
    done = batch.select("action_id").distinct().withColumn("done", F.lit(True))
    joined = actions.filter(open_).join(done, "action_id", "left")
    stamp = F.when(F.col("done"), as_timestamp(applied_at)).cast(actions.schema["feedback_applied_at"].dataType)
    marked = joined.select(*[stamp.alias(n) if n == "feedback_applied_at" else F.col(n) for n in actions.columns])
    return actions.filter(~F.coalesce(open_, F.lit(False))).unionByName(marked)


def feedback_summary(batch: DataFrame) -> DataFrame:
    """Volumes of a feedback run; no row when there was nothing to do."""
    delta = health_delta(F.col("outcome"))

    def count_if(condition):
        return F.count(F.when(condition, F.lit(1)))

    return batch.agg(
        F.count(F.lit(1)).alias("executions_processed"),
        count_if(delta != 0).alias("health_updates"),
        count_if(delta > 0).alias("positive_outcomes"),
        count_if(delta < 0).alias("negative_outcomes"),
        count_if(F.col("outcome") == "call_completed_churned").alias("churn_confirmed"),
        count_if(F.col("outcome") == "upgraded").alias("upgrades_confirmed"),
    ).filter("executions_processed > 0")


def feedback_signals(batch: DataFrame) -> DataFrame:
    """Customers to score again soon: one row per confirming outcome, repeats kept."""
    signal = F.when(F.col("outcome") == "call_completed_churned", "churn_confirmed").when(
        F.col("outcome") == "upgraded", "upgrade_confirmed"
    )
    return batch.select("customer_id", "action_id", signal.alias("signal")).filter("signal IS NOT NULL")
