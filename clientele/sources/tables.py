"""Readers for the seven tables and the additive schema migration."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.schemas import TABLES


def load_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """One table of the data model from ``folder/name``, in its declared schema.

    A CSV file with a header is read by its column names, in any order; columns it lacks are null, and a cell that is no
    value of its type is an error. Without a header its columns stand in declared order, and JSON is read by name; a
    malformed row is an error there, too. Columnar files carry their own schema, so they are read as
    they are and conformed; pruning still reaches the scan.
    With ``jdbc`` the table is named in the database that ``options`` describe.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return conform(reader.option("dbtable", name).load(), TABLES[name])
    if fmt == "csv" and options.get("header", "false").lower() == "true":
        return _typed(reader.option("inferSchema", "false").load(f"{folder}/{name}"), TABLES[name])
    if fmt in ("csv", "json"):
        return reader.option("mode", "FAILFAST").schema(TABLES[name]).load(f"{folder}/{name}")
    return conform(reader.load(f"{folder}/{name}"), TABLES[name])


def load_tables(spark: SparkSession, folder: str, fmt: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """All seven tables; nothing is read before an action uses them."""
    return {name: load_table(spark, folder, name, fmt, **options) for name in TABLES}


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The score columns that the decision steps need, and no others."""
    return predictions.select(
        "customer_id", "churn_score", "conversion_score", "segment", "ltv_estimate"
    )


def _typed(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns by name in declared order and type; a text that is no such value ends the job."""
    columns = []
    for field in schema.fields:
        if field.name not in texts.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{field.name}`")
        value = text.try_cast(field.dataType)
        told = F.concat(F.lit(f"column {field.name}: no {field.dataType.simpleString()}: "), text)
        wrong = text.isNotNull() & value.isNull()
        columns.append(F.when(wrong, F.raise_error(told).cast(field.dataType)).otherwise(value).alias(field.name))
    extra = [F.col(f"`{name}`") for name in texts.columns if name not in schema.names]
    return texts.select(*columns, *extra)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the missing columns as typed nulls and put all in declared order and type.

    Running it again changes nothing; columns outside the schema stay at the end.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    if list(have.items()) == [(f.name, f.dataType) for f in schema.fields]:
        return df
    wanted = [
        F.col(f.name) if have.get(f.name) == f.dataType
        else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    extra = [F.col(name) for name in have if name not in schema.names]
    return df.select(*wanted, *extra)
