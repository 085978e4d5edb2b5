"""Readers for the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as an instant (stored without a zone, read as UTC)."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
