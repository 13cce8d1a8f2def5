"""Scans of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, its local timestamps cast once to instants (the session runs in UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df
