"""Node, edge and triple tables: upsert by id, load by type, JSON in and out.

Tables are partitioned by a hash of the id, so an id that changes its type replaces its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import read_table, upsert

BUCKETS = 32


def save(spark: SparkSession, rows: DataFrame, root: str, seq: str = "created_at") -> None:
    """Rows of (id, type, ...), newest write per id."""
    upsert(spark, _bucketed(rows), root, ["id"], ["bucket"], seq)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))


def load(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    df = read_table(spark, root)
    if df is None:
        raise FileNotFoundError(root)
    return (df if kind is None else df.where(F.col("type") == kind)).drop("bucket")


def export_json(rows: DataFrame, path: str, gzip: bool = False) -> None:
    writer = rows.write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def import_rows(spark: SparkSession, rows: DataFrame, root: str, merge: bool) -> None:
    """Merge into the table, or replace it."""
    if merge:
        save(spark, rows, root)
    else:
        _bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(root)
