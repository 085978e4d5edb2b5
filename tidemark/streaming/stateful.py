"""Streaming operators with event time and state.

A hot key is merged before it reaches keyed state: windowed sums have a partial
aggregate, and the alert state sees one row per rule and clock tick.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.columns import flag
from tidemark.operators.features import FeatureBook
from tidemark.operators.metrics import breaches, windowed_statistics

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(stream: DataFrame, window: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Statistics per event-time window; rows later than ``late`` are not counted."""
    return windowed_statistics(stream.withWatermark("ts", late), window, slide)


def deduplicated(stream: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def sessions(stream: DataFrame, keys: Sequence[str], gap: str, late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows"
    )


def alerts(stream: DataFrame, rules: DataFrame, tick: str = "1 minute", cool_down: int = 300, late: str = "1 hour") -> DataFrame:
    """Fired alerts of a metric stream: breaches per rule and tick, then the cool-down.

    Needs the RocksDB state store."""
    hit = breaches(stream.withWatermark("ts", late), rules)
    ticked = hit.groupBy("rule_id", F.window("ts", tick).alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    ticked = ticked.select("rule_id", F.unix_timestamp("w.start").alias("tick"), "samples")

    processor = _CoolDown()
    processor.seconds = cool_down
    return ticked.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="rule_id string, tick long, samples long",
        outputMode="Append",
        timeMode="None",
    )


class _CoolDown(StatefulProcessor):
    """Lets a rule fire only when its last alert is older than the cool-down."""

    seconds = 300

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "last long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.fired.get()[0] if self.fired.exists() else None
        frame = pd.concat(list(rows)).sort_values("tick")
        keep = []
        for t in frame["tick"].to_numpy():
            ok = last is None or t - last >= self.seconds
            keep.append(ok)
            last = int(t) if ok else last
        self.fired.update((last,))
        yield frame[keep][["rule_id", "tick", "samples"]]

    def close(self) -> None:
        pass


class _CountWindows(StatefulProcessor):
    """Closes a window of a key at every ``size`` rows; the rest waits in state."""

    size = 100
    wait = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "count long, total double, windows long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.open.get() if self.open.exists() else (0, 0.0, 0)
        count, total, windows = held[0], held[1], held[2]
        out = []
        for frame in rows:
            values = frame["value"].to_numpy(float)
            cuts = range(self.size - count, len(values) + 1, self.size)
            at = 0
            for cut in cuts:
                out.append((key[0], windows, self.size, total + float(values[at:cut].sum())))
                count, total, windows, at = 0, 0.0, windows + 1, cut
            count, total = count + len(values) - at, total + float(values[at:].sum())
        self.open.update((count, total, windows))
        if self.wait is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if count:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield pd.DataFrame(out, columns=["name", "window", "rows", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        count, total, windows = self.open.get() if self.open.exists() else (0, 0.0, 0)
        out = [(key[0], windows, count, total)] if count else []
        self.open.update((0, 0.0, windows + len(out)))
        yield pd.DataFrame(out, columns=["name", "window", "rows", "total"])

    def close(self) -> None:
        pass


def count_windows(stream: DataFrame, size: int = 100, shards: int = 1, wait: int | None = None) -> DataFrame:
    """Windows of ``size`` messages per name, held in the RocksDB state store.

    A window also closes ``wait`` milliseconds after its last message; without ``wait``, as in a
    backfill, ``open_windows`` reads what is open at the end.

    ``shards`` splits the messages of a name by id, so no key holds a whole hot name;
    a window then holds messages of one shard.
    """
    key = F.concat_ws("#", "name", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("string")) if shards > 1 else F.col("name")
    processor = _CountWindows()
    processor.size, processor.wait = size, wait
    return stream.select(key.alias("name"), "value").groupBy("name").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="name string, window long, rows long, total double",
        outputMode="Append",
        timeMode="None" if wait is None else "ProcessingTime",
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows that ``count_windows`` holds open in the state of an ended stream."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    held = state.select(F.col("key").getField("name").alias("name"), "value.*")
    return held.where("count > 0").select("name", F.col("windows").alias("window"), F.col("count").alias("rows"), "total")


def quality(stream: DataFrame, fields: Sequence[str], window: str, late: str = "1 hour") -> DataFrame:
    """Rows, empty cells and share of empty cells per source and window."""
    empty = [flag(F.col(f).isNull() | (F.col(f).cast("string") == "")) for f in fields]
    rows = stream.withWatermark("ts", late).groupBy("source", F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(sum(empty[1:], empty[0])).alias("empty")
    )
    return rows.select(
        "source", F.col("w.start").alias("start"), "rows", "empty", (F.col("empty") / (F.col("rows") * len(fields))).alias("empty_rate")
    )


class _Tail(StatefulProcessor):
    """Holds the last ``reach`` rows of a key by date, and sends them ahead of the key's new rows."""

    reach = 19
    columns: tuple[str, ...] = ()
    schema = ""
    keep = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", self.schema, self.keep)

    def handleInputRows(self, key, rows, timerValues):
        columns = list(self.columns)
        new = pd.concat(list(rows), ignore_index=True)[columns].assign(is_new=True)
        held = pd.DataFrame([tuple(r) for r in self.tail.get()], columns=columns) if self.tail.exists() else new[columns].head(0)
        # of equal dates the held row stays ahead; rows of a batch are ordered by all they hold
        new = new.sort_values(columns, na_position="first")
        both = pd.concat([held.assign(is_new=False), new]) if len(held) else new
        both = both.sort_values("date", kind="stable")
        last = both[columns].tail(self.reach)
        if len(last):
            self.tail.put([tuple(None if pd.isna(v) else v for v in r) for r in last.itertuples(index=False, name=None)])
        yield both

    def close(self) -> None:
        pass


def with_tail(stream: DataFrame, key: str, reach: int, keep: int | None = None) -> DataFrame:
    """Rows of a stream with ``date``, flagged ``is_new``, and the last ``reach`` rows before them of their ``key``.

    The tail lives in the RocksDB state store, at most ``reach`` rows a key, so the work of a
    batch follows the batch and not the history. A key that is silent for ``keep`` milliseconds
    loses its tail. A late row sees those rows before it that are still held; rows that were
    sent already are not sent anew.
    """
    fields = [stream.schema[c].simpleString().replace(":", " ", 1) for c in stream.columns]
    processor = _Tail()
    processor.reach, processor.columns, processor.schema, processor.keep = reach, tuple(stream.columns), ", ".join(fields), keep
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{processor.schema}, is_new boolean",
        outputMode="Append",
        timeMode="None" if keep is None else "ProcessingTime",
    )


def feature_step(folder: str, names: Sequence[str]):
    """foreachBatch function for rows of :func:`with_tail`: features of the new bars, below
    ``folder``/features by batch, so a replayed batch overwrites itself."""

    def step(batch: DataFrame, number: int) -> None:
        out = FeatureBook().compute(batch, names).where("is_new").drop("is_new")
        out.write.mode("overwrite").parquet(f"{folder}/features/batch={number}")

    return step
