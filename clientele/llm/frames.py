"""Helpers that several operators share: rows kept aside as one struct, and tables kept in the shared folder."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.session import scratch_path


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
