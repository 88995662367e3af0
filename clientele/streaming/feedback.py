"""Outcome events update health once per action, in event order, however often and however late they arrive.

Below ``state`` lie the events by micro-batch and day, and the combined health step of every customer and day. A
micro-batch folds the days it touches anew, with all their events, and the newest fold of a day counts. So a late
outcome finds its place before those of later days, and a batch reads the days it touches, not the history.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clientele.operators.feedback import apply_steps, fold_steps, health_steps


def _first_copy(batch: DataFrame) -> DataFrame:
    """One row per action; copies merge before the shuffle, the earliest stays."""
    event = F.struct("executed_at", "customer_id", "outcome")
    kept = batch.filter("action_id IS NOT NULL AND executed_at IS NOT NULL").groupBy("action_id").agg(F.min(event).alias("event"))
    return kept.select("action_id", "event.*")


def start_feedback(outcomes: DataFrame, state: str) -> StreamingQuery:
    """Fold a stream of (action_id, customer_id, outcome, executed_at) until it has no more input.

    Each micro-batch owns one folder per table below ``state``: its events, and one health step per customer for each
    of their days. A replayed batch overwrites its own folders, so a failure at any point changes nothing
    twice. Copies of an outcome carry its time, so they meet on its day. The stream's checkpoint lies next to the
    tables, as they are only valid together.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = _first_copy(batch).withColumn("day", F.to_date("executed_at"))
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{state}/events/batch_id={batch_id}")
        arrived = spark.read.parquet(f"{state}/events").filter(F.col("batch_id") <= batch_id)
        # The days of one micro-batch: partition names, at most a few.
        days = [r["day"] for r in arrived.filter(F.col("batch_id") == batch_id).select("day").distinct().collect()]
        once = _first_copy(arrived.filter(F.col("day").isin(days)))
        steps = health_steps(once.withColumn("day", F.to_date("executed_at")), keys=("customer_id", "day"))
        steps.write.mode("overwrite").parquet(f"{state}/steps/batch_id={batch_id}")

    return (
        outcomes.writeStream.foreachBatch(fold)
        .option("checkpointLocation", f"{state}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def day_steps(spark: SparkSession, state: str) -> DataFrame:
    """The newest fold of every day: customer_id, day, shift, floor, ceiling."""
    steps = spark.read.parquet(f"{state}/steps")
    newest = steps.groupBy("day").agg(F.max("batch_id").alias("batch_id"))
    return steps.join(newest, ["day", "batch_id"], "left_semi").drop("batch_id")


def compact_steps(spark: SparkSession, state: str, path: str) -> DataFrame:
    """The newest folds written to ``path`` by day, and read from there."""
    day_steps(spark, state).write.mode("overwrite").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def current_health(spark: SparkSession, customers: DataFrame, state: str) -> DataFrame:
    """Customers with every outcome so far folded into their health, day by day."""
    return apply_steps(customers, fold_steps(day_steps(spark, state), ("day",)))
