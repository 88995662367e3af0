"""Joining many rows with one profile per key when single keys may be very large."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
NULL_PARTS = 1024


def join_profiles(
    rows: DataFrame, profiles: DataFrame, key: str, row_id: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of ``rows`` with the one profile of their key.

    A key with more than ``hot_rows`` rows is split into parts by a hash of ``row_id``,
    and only its profile is repeated, once per part; all other keys have one part.
    There are at most ``rows / hot_rows`` such keys, each a key and a number, so they
    are broadcast. Rows without a key are spread as well, as they match nothing.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(
        counts.filter(F.col(key).isNotNull() & (F.col("n") > hot_rows)).select(
            key, F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")
        )
    )
    parts = F.when(F.col(key).isNull(), F.lit(NULL_PARTS)).otherwise(F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64(row_id), parts).cast("int")
    split = rows.join(hot, key, "left").withColumn("part", part).drop("parts")
    every_part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    repeated = profiles.join(hot, key, "left").withColumn("part", every_part).drop("parts")
    return split.join(repeated, [key, "part"], "left").drop("part")
