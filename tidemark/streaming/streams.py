"""Streams: sources, message parsing, dead letters, handlers, triggers and statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = (
    "message_id string, stream_type string, timestamp string, data map<string,string>, source string, "
    "priority int, metadata map<string,string>"
)


@dataclass(frozen=True)
class StreamConfig:
    """A named stream: its kind, how it is processed, and the size of a batch."""

    name: str
    stream_type: str
    mode: str = "real_time"
    batch_size: int = 100
    batch_timeout: float = 1.0


# The streams every installation has.
DEFAULT_STREAMS = (
    StreamConfig("market_data", "market_data", "real_time"),
    StreamConfig("news_data", "news_data", "batch", 50, 5.0),
    StreamConfig("factor_data", "factor_data", "micro_batch", 200, 2.0),
    StreamConfig("trading_signals", "trading_signals", "real_time", 10, 0.5),
    StreamConfig("system_alerts", "system_alerts", "real_time"),
)


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_kafka(spark: SparkSession, config: StreamConfig, servers: str, starting: str = "latest", per_trigger: int | None = None) -> DataFrame:
    """Values of a topic, all there is in a trigger unless bounded; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", config.name)
        .option("startingOffsets", starting)
    )
    if per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def publish(messages: DataFrame, target: str, servers: str | None = None) -> None:
    """Messages as JSON, keyed by message_id, to a topic or a folder."""
    keyed = messages.select(F.col("message_id").alias("key"), F.to_json(F.struct(*messages.columns)).alias("value"))
    if servers is None:
        keyed.select("value").write.mode("append").text(target)
    else:
        keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", target).save()


def trigger(config: StreamConfig, backfill: bool = False) -> dict:
    """Trigger arguments of a mode: as fast as possible, by timeout, or all there is."""
    if backfill:
        return {"availableNow": True}
    seconds = {"real_time": 0.0, "batch": config.batch_timeout, "micro_batch": 0.1, "streaming": 1.0}[config.mode]
    return {"processingTime": f"{int(seconds * 1000)} milliseconds"}


def parse(raw: DataFrame, types: Sequence[str] = tuple(c.stream_type for c in DEFAULT_STREAMS)) -> DataFrame:
    """Message columns with defaults, and ``error`` for what cannot be handled."""
    m = F.from_json("value", MESSAGE)
    df = raw.select("value", m.alias("m"))
    ts = F.try_to_timestamp("m.timestamp")
    error = (
        F.when(F.col("m.message_id").isNull(), "unreadable")
        .when(~F.col("m.stream_type").isin(list(types)), "unknown type")
        .when(ts.isNull(), "bad time")
    )
    return df.select(
        "value",
        F.col("m.message_id").alias("message_id"),
        F.col("m.stream_type").alias("stream_type"),
        ts.alias("ts"),
        F.col("m.data").alias("data"),
        F.coalesce("m.source", F.lit("unknown")).alias("source"),
        F.coalesce("m.priority", F.lit(0)).alias("priority"),
        error.alias("error"),
    )


Handler = Callable[[DataFrame, int], None]


def run_handlers(parsed: DataFrame, handlers: Mapping[str, Sequence[Handler]], folder: str, config: StreamConfig, backfill: bool = False) -> StreamingQuery:
    """Give every micro-batch to the handlers of its types.

    Unreadable rows and the batches of a failing handler go to the dead-letter folder,
    named by batch, so a replayed batch overwrites its own letters.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        letters = f"{folder}/dead_letters/batch={number}"
        dead = batch.where(F.col("error").isNotNull()).select("value", "error")
        for kind, todo in handlers.items():
            rows = batch.where((F.col("stream_type") == kind) & F.col("error").isNull())
            for handler in todo:
                try:
                    handler(rows, number)
                except Exception as failure:  # the other handlers still get the batch
                    why = f"{getattr(handler, '__name__', 'handler')}: {type(failure).__name__}"
                    dead = dead.unionByName(rows.select("value", F.lit(why).alias("error")))
        dead.write.mode("overwrite").json(letters)
        batch.unpersist()

    return (
        parsed.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger(config, backfill))
        .start()
    )


def to_folder(stream: DataFrame, folder: str, backfill: bool = True, every: str = "1 second") -> StreamingQuery:
    """Append a stream to Parquet below ``folder``."""
    when = {"availableNow": True} if backfill else {"processingTime": every}
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .trigger(**when)
        .start()
    )


#: Where an ended stream's time stands: past the end of every window.
END = "9999-12-30 00:00:00"


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` together with a source below ``folder`` that can tell its end (:func:`tell_end`)."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/end")
    return stream.unionByName(read_files(spark, f"{folder}/end", stream.schema))


def tell_end(spark: SparkSession, folder: str, ts: str = "ts") -> None:
    """One last row, with empty strings and nulls, at a time past all windows.

    It moves the watermark, so every window before it closes; its own windows never do. An ended
    stream takes no further rows.
    """
    schema = spark.read.parquet(f"{folder}/end").schema
    value = lambda f: F.lit(END if f.name == ts else "" if f.dataType.typeName() == "string" else None).cast(f.dataType).alias(f.name)
    spark.range(1).select(*map(value, schema.fields)).write.mode("append").parquet(f"{folder}/end")


def backfill(build: Callable[[DataFrame], DataFrame], source: DataFrame, folder: str) -> DataFrame:
    """All rows of ``build(source)``, those of the windows that are open when the input ends among them.

    The stream is run over its input first, and told the end only then, so that no row of a
    later batch counts as late because of it.
    """
    spark = source.sparkSession
    stream = build(with_end(source, folder))
    to_folder(stream, folder).awaitTermination()
    tell_end(spark, folder)
    return finish(to_folder(stream, folder), spark, folder)


def finish(query: StreamingQuery, spark: SparkSession, folder: str) -> DataFrame:
    """Wait for a backfill, however long, and read what it wrote; its error is raised here."""
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def statistics(query: StreamingQuery) -> dict:
    """Rows received, batches, rate and state size from the query's own progress."""
    progress = query.recentProgress
    rows = [int(p["numInputRows"]) for p in progress]
    failed = query.exception() is not None
    return {
        "batches": len(progress),
        "received": sum(rows),
        "last_batch": rows[-1] if rows else 0,
        "active": query.isActive,
        "healthy": not failed,
    }
