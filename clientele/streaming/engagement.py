"""Event counts per customer and day, kept up by a stream.

Below ``state`` lie the events by micro-batch and day, and the counts of every customer and day. A micro-batch counts the days
it touches anew, one per event id, so a repeated event counts once and a late one like any other: there is no
watermark that would drop it, and a batch reads the days it touches, not the history.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clientele.functions import as_timestamp, days_before


def _once(events: DataFrame) -> DataFrame:
    """One row per event; copies merge before the shuffle."""
    known = events.filter("customer_id IS NOT NULL AND event_id IS NOT NULL AND event_day IS NOT NULL")
    return known.groupBy("event_id").agg(F.min(F.struct("event_day", "customer_id")).alias("e")).select("event_id", "e.*")


def start_engagement(events: DataFrame, state: str) -> StreamingQuery:
    """Count a stream of engagement events until it has no more input; replays overwrite themselves."""

    def count(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = _once(batch.select("event_id", "customer_id", F.to_date("event_date").alias("event_day")))
        fresh.write.mode("overwrite").partitionBy("event_day").parquet(f"{state}/events/batch_id={batch_id}")
        arrived = spark.read.parquet(f"{state}/events").filter(F.col("batch_id") <= batch_id)
        # The days of one micro-batch: partition names, at most a few.
        days = [r["event_day"] for r in arrived.filter(F.col("batch_id") == batch_id).select("event_day").distinct().collect()]
        once = _once(arrived.filter(F.col("event_day").isin(days)))
        daily = once.groupBy("customer_id", "event_day").agg(F.count("event_id").alias("events"))
        daily.write.mode("overwrite").partitionBy("event_day").parquet(f"{state}/daily/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(count)
        .option("checkpointLocation", f"{state}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def daily_counts(spark: SparkSession, state: str) -> DataFrame:
    """The newest count of every day: customer_id, event_day, events. A filter on the day prunes the files."""
    counts = spark.read.parquet(f"{state}/daily")
    newest = counts.groupBy("event_day").agg(F.max("batch_id").alias("batch_id"))
    return counts.join(newest, ["event_day", "batch_id"], "left_semi").select("customer_id", "event_day", "events")


def compact_daily(spark: SparkSession, state: str, path: str) -> DataFrame:
    """The newest counts written to ``path`` by day, and read from there."""
    daily_counts(spark, state).write.mode("overwrite").partitionBy("event_day").parquet(path)
    return spark.read.parquet(path)


def rolling_counts(daily: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Events per customer in the last ``days`` whole days before ``as_of``."""
    window = (F.col("event_day") >= days_before(as_of, days).cast("date")) & (
        F.col("event_day") < as_timestamp(as_of).cast("date")
    )
    return daily.filter(window).groupBy("customer_id").agg(F.sum("events").alias("event_count"))
