"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``{folder}/{name}.parquet``; zone-less timestamps are taken as UTC instants so that they mix with TIMESTAMP."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
