"""Streams with event time: every id counts once, late rows go below a watermark, and state is kept by Spark and expires.

``delay`` is how long rows may lag behind the newest one seen. Within it a repeated id is dropped, under whatever day
it comes, and the first to arrive counts; its record expires with the watermark. Rows older than the watermark are dropped: they are
what the state no longer can place. Results are appended when the watermark has passed their window (sliding ones: the block
of windows they belong to), so each is final and stands once in the output, also after a restart from the checkpoint.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clientele.operators.feedback import HIGH, LOW, composed, apply_steps, fold_steps, health_delta

# Windows of more slots have a row of state each.
MOST_SLOTS = 60


def clock_instant(time: Column) -> Column:
    """A time without zone as the instant at which a clock in UTC shows it, in any session time zone."""
    return F.from_utc_timestamp(time.cast("timestamp"), F.current_timezone())


def clock_time(instant: Column) -> Column:
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def first_arrivals(rows: DataFrame, row_id: str, time: str, delay: str) -> DataFrame:
    """Rows with a watermark on ``at`` (the instant of ``time``), one per id; rows without an id or a time are left out."""
    known = rows.filter(F.col(row_id).isNotNull() & F.col(time).isNotNull()).withColumn("at", clock_instant(F.col(time)))
    return known.withWatermark("at", delay).dropDuplicatesWithinWatermark([row_id])


def rolling_event_counts(events: DataFrame, delay: str = "2 days", length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """Events per customer in sliding windows: customer_id, until (the end of the window, exclusive), event_count.

    A customer's state is one row of counts by ``slide`` for each two neighbouring blocks of ``length``, and not a row for each window: every
    window that ends in the second block lies in the two. Windows are so appended when the watermark has passed their block.
    """
    once = first_arrivals(events.filter("customer_id IS NOT NULL"), "event_id", "event_date", delay)
    step, whole = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (slide, length))
    n = whole // step
    if n > MOST_SLOTS:
        return _rolling_by_slots(once, length, slide)
    blocks = once.withColumn("span", F.window("at", f"{2 * n * step} microseconds", f"{n * step} microseconds"))
    blocks = blocks.withColumn("slot", F.floor((F.unix_micros("at") - F.unix_micros("span.start")) / step))
    counted = blocks.groupBy("span", "customer_id").agg(*[F.expr(f"count_if(slot = {k}) AS n{k}") for k in range(2 * n)])
    # The window that ends with slot k of the second block begins with slot k + 1 of the first.
    counts, start = F.array(*[f"n{k}" for k in range(2 * n)]), F.unix_micros("span.start")
    rolled = counted.select("customer_id", start.alias("start"), counts.alias("counts")).select(
        "customer_id", "start", "counts", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")
    )
    events = F.aggregate(F.slice("counts", F.col("k") + 1, n), F.lit(0).cast("bigint"), lambda a, b: a + b)
    until = F.timestamp_micros(F.col("start") + F.col("k") * step + whole)
    rolled = rolled.select("customer_id", until.alias("until"), events.alias("event_count")).filter("event_count > 0")
    return rolled.select("customer_id", clock_time(F.col("until")).alias("until"), "event_count")


def _rolling_by_slots(once: DataFrame, length: str, slide: str) -> DataFrame:
    """The same for windows of very many slots: events are counted by ``slide`` first, and the windows slide over these counts."""
    slots = once.groupBy(F.window("at", slide).alias("slot"), "customer_id").agg(F.count(F.lit(1)).alias("events"))
    rolled = slots.groupBy(F.window(F.window_time("slot"), length, slide).alias("span"), "customer_id").agg(F.sum("events").alias("event_count"))
    return rolled.select("customer_id", clock_time(F.col("span.end")).alias("until"), "event_count")


def ordered_steps(outcomes: DataFrame, delay: str = "2 days", slot: str = "1 hour") -> DataFrame:
    """Health steps per customer and slot, folded in event order: customer_id, slot, shift, floor, ceiling.

    The outcomes of a slot wait in the state until the watermark has passed it; then they are ordered by time and action id. Steps of
    one customer compose, so a busy customer is spread over the slots.
    """
    once = first_arrivals(outcomes.filter("customer_id IS NOT NULL"), "action_id", "executed_at", delay)
    delta = health_delta(F.col("outcome"))
    moves = once.filter(delta != 0).withColumn("shift", delta)
    waiting = F.struct("at", "action_id", "shift", F.lit(LOW).alias("floor"), F.lit(HIGH).alias("ceiling"))
    slots = moves.groupBy(F.window("at", slot).alias("slot"), "customer_id").agg(F.collect_list(waiting).alias("run"))
    step = composed(F.transform(F.array_sort("run"), lambda x: F.struct(x["shift"].alias("shift"), x["floor"].alias("floor"), x["ceiling"].alias("ceiling"))))
    return slots.select("customer_id", clock_time(F.col("slot.start")).alias("slot"), step.alias("step")).select("customer_id", "slot", "step.*")


def append_to(rows: DataFrame, state: str) -> StreamingQuery:
    """Append what a stream finishes to ``state``/rows until its input is used up; a restart goes on from the checkpoint."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", f"{state}/rows").option("checkpointLocation", f"{state}/_checkpoint")
        .trigger(availableNow=True).start()
    )


def appended(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/rows")


def ordered_health(spark: SparkSession, customers: DataFrame, state: str) -> DataFrame:
    """Customers with all finished slots folded into their health, in order."""
    return apply_steps(customers, fold_steps(appended(spark, state), ("slot",)))
