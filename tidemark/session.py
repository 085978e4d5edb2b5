"""Spark session and shared-folder settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(current)
    return current


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when each of them ends, not when the driver happens
    to collect garbage. For jobs that write a table: nothing reads their shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so a lost executor costs no replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_path`` that has no reader left."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound what an Arrow batch holds, so that long texts cannot fill a worker's memory. Stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


class Kept:
    """A table written once to the shared folder, and what the same job observed of it.

    The observed rows are those of the job's last stage, which counts a task once however
    often it runs again.
    """

    def __init__(self, df: DataFrame, *metrics: Column, codec: str | None = None):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, "kept")
        seen = Observation()
        with shuffles_dropped(self.spark):
            df.observe(seen, *metrics).write.parquet(self.path, compression=codec)
        self.told = seen.get
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


class Bucketed:
    """A table in hash buckets of its keys, so joins on the keys leave it where it lies."""

    def __init__(self, df: DataFrame, keys: Sequence[str], buckets: int):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, "buckets")
        self.name = f"default.buckets_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            (
                df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
                .option("path", self.path).saveAsTable(self.name)
            )
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
