"""Writers. Each can be run again after a failure without doubling or losing rows.

The action table is a folder partitioned by ``status``: the large executed part
only ever grows by appends, and the small pending part is rewritten on its own.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.functions import as_timestamp
from clientele.schemas import TABLES
from clientele.sources.tables import conform

_ACTION_FILES = [c for c in TABLES["agent_actions"].names if c != "status"]
_FEEDBACK_LOG = "action_id string, executed_at timestamp_ntz, feedback_applied_at timestamp_ntz"


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _is_complete(spark: SparkSession, path: str) -> bool:
    return _read_or_empty(spark, f"{path}-complete", "id bigint").count() > 0


def _complete(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}-complete")


def write_once(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written from ``df`` unless an earlier attempt completed it."""
    spark = df.sparkSession
    if not _is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
        _complete(spark, path)
    return spark.read.parquet(path)


def _not_stored(rows: DataFrame, stored: DataFrame, key: str, time: str) -> DataFrame:
    """Rows whose key is not stored yet.

    An earlier attempt wrote the same rows at the same times, so only that time range
    is searched, which skips the other files; the stored keys are probed with those
    of the batch rather than shuffled against it.
    """
    span = rows.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    if span["low"] is None:
        return rows
    near = stored.filter(F.col(time).between(as_timestamp(span["low"]), as_timestamp(span["high"])))
    seen = near.select(key).join(rows.select(key), key, "left_semi")
    return rows.join(seen, key, "left_anti").select(*rows.columns)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Rebuild all tables in ``folder``, which must not be where the frames are read from.

    Tables without a frame are written empty, so that no rows of an older build remain.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, schema in TABLES.items():
        rows = tables[name] if name in tables else spark.createDataFrame([], schema)
        conform(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Replace all predictions. ``path`` must not be among the inputs of the frame."""
    conform(predictions, TABLES["ml_predictions"]).write.mode("overwrite").parquet(path)


def _action_part(path: str, status: str) -> str:
    return f"{path}/status={status}"


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The action table; a filter on ``status`` prunes to that part's files."""
    return conform(spark.read.parquet(path), TABLES["agent_actions"])


def write_actions(actions: DataFrame, path: str) -> None:
    """Write the whole action table to a new folder."""
    conform(actions, TABLES["agent_actions"]).write.partitionBy("status").parquet(path)


def write_pending(queue: DataFrame, path: str) -> None:
    """Replace the pending part only. An empty queue clears it; history stays as it is."""
    queue.select(*_ACTION_FILES).write.mode("overwrite").parquet(_action_part(path, "pending"))


def commit_outcomes(spark: SparkSession, path: str, executed: DataFrame, staging: str) -> DataFrame:
    """Move executed rows out of the pending part, and return them as they were committed.

    ``staging`` belongs to this one batch. The batch and the remaining pending rows
    are kept there before anything is changed, so an attempt that fails between the
    steps is finished by the next one, and an attempt after the end does nothing.
    """
    batch = write_once(executed, f"{staging}/batch")
    if _is_complete(spark, f"{staging}/commit"):
        return batch
    done = read_actions(spark, path).filter("status = 'executed'")
    _not_stored(batch.select(*_ACTION_FILES), done, "action_id", "executed_at").write.mode("append").parquet(
        _action_part(path, "executed")
    )
    pending = read_actions(spark, path).filter("status = 'pending'")
    remaining = pending.join(batch.select("action_id"), "action_id", "left_anti")
    write_pending(write_once(remaining, f"{staging}/pending"), path)
    _complete(spark, f"{staging}/commit")
    return batch


def append_email_log(spark: SparkSession, emails: DataFrame, path: str) -> None:
    """Append the log rows whose id is not there yet."""
    rows = conform(emails, TABLES["email_log"])
    log = _read_or_empty(spark, path, TABLES["email_log"])
    _not_stored(rows, log, "email_id", "sent_at").write.mode("append").parquet(path)


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of applied actions, empty before its first batch."""
    return _read_or_empty(spark, path, _FEEDBACK_LOG)


def append_feedback_log(spark: SparkSession, batch: DataFrame, applied_at, path: str) -> None:
    """Note the batch as applied, instead of rewriting the executed part of the action table."""
    rows = batch.select("action_id", "executed_at", as_timestamp(applied_at).alias("feedback_applied_at"))
    log = read_feedback_log(spark, path)
    _not_stored(rows, log, "action_id", "executed_at").write.mode("append").parquet(path)
