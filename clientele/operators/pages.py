"""The first rows of an order, as many as asked for, without sorting them all in one task.

A small page is a top-k. A large one is found by its cut: counts over ranges of the leading score say which range holds the last row;
rows beyond it are out, and what is left is dealt to tasks by ranges of the whole order. Whole ranges
are taken as they are, and only the last one is cut. The driver sees a count per range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.session import stored

ONE_TASK_ROWS = 10_000
RANGES, LEVELS = 1024, 4


def _score_cut(rows: DataFrame, score: str, limit: int) -> float | None:
    """A lower bound of the ``limit`` highest scores; None if there are not that many rows with a score."""
    known = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).cast("double").alias("x"))
    low, high, count = known.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    if count <= limit:
        return None
    for _ in range(LEVELS):
        width = (high - low) / RANGES
        if not 0 < width < float("inf") or low + width == low:
            break
        place = F.when(F.col("x") > high, RANGES).otherwise(F.least(F.floor((F.col("x") - low) / width), F.lit(RANGES - 1)))
        counts = dict(known.filter(F.col("x") >= low).groupBy(place.alias("place")).agg(F.count(F.lit(1))).collect())
        seen = 0
        for k in sorted(counts, reverse=True):
            seen += counts[k]
            if seen >= limit:
                break
        # The range of the last row, with one more on both sides for what rounding does.
        low, high = low + max(k - 1, 0) * width, low + (k + 2) * width
        if seen - limit <= max(limit // 10, ONE_TASK_ROWS):
            break
    return low


def first_rows(
    rows: DataFrame, order: Sequence[Column], limit: int, score: str | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """The first ``limit`` rows in ``order``, which must tell all rows apart.

    ``score`` names the leading column if that is a number in descending order with nulls last. A page of up to
    ``one_task_rows`` rows comes sorted; a larger one comes in no order.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit <= one_task_rows:
        return rows.orderBy(*order).limit(limit)
    if score is not None:
        cut = _score_cut(rows, score, limit)
        if cut is not None:
            # NaN sorts above all numbers.
            rows = rows.filter((F.col(score) >= cut) | F.isnan(score))
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dict(ranged.groupBy("_range").agg(F.count(F.lit(1))).collect())
    whole, left = -1, limit
    for part in sorted(counts):
        if counts[part] > left:
            break
        whole, left = part, left - counts[part]
    else:
        return ranged.drop("_range")
    edge = ranged.filter(F.col("_range") == part).orderBy(*order).limit(left)
    return ranged.filter(F.col("_range") <= whole).unionByName(edge).drop("_range")
