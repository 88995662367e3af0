"""Insert-or-replace by key, and replacing the pending part of the action table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """The row with the greatest ``order_by`` for each key; equal ones are decided by the other columns.

    An aggregate with map-side partials rather than a window: a key that holds a
    large part of the rows shrinks to one row per task before the shuffle.
    """
    ranked = F.struct(order_by, *[c for c in rows.columns if c != order_by])
    picked = rows.groupBy(*keys).agg(F.max(ranked).alias("row"))
    return picked.select(*[F.col(f"row.{c}").alias(c) for c in rows.columns])


def upsert_by_key(base: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """``base`` with each key of ``incoming`` inserted or replaced; the last one wins.

    ``base`` has unique keys already. ``order_by`` ranks repeated keys inside
    ``incoming`` and is dropped unless it is a column of ``base``.
    """
    fresh = last_per_key(incoming, keys, order_by).select(*base.columns)
    kept = base.join(fresh.select(*keys), list(keys), "left_anti").select(*base.columns)
    return kept.unionByName(fresh)


def replace_pending(actions: DataFrame, queue: DataFrame) -> DataFrame:
    """The action table with its pending rows replaced by ``queue``, which may be empty."""
    history = actions.filter(~F.col("status").eqNullSafe("pending"))
    return history.unionByName(queue.select(*actions.columns))
