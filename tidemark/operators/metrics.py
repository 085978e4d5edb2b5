"""Metric samples and alerts: statistics, thresholds, cool-downs, error rates.

A metric or rule may hold a third of all samples. Statistics are grouped sums and exact
split percentiles; the cool-down runs on clock ticks, so a rule's series is as long as
the clock and not as its samples.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.columns import flag
from tidemark.operators.quantiles import exact_quantiles


def metric_statistics(samples: DataFrame, start=None, end=None, name: str = "name", tie: str = "event_id") -> DataFrame:
    """Count, range, mean, median, deviation and latest value in the look-back span."""
    if start is not None:
        samples = samples.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    order = (F.unix_micros("ts").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")
    stats = samples.withColumn("__o", order).groupBy(name).agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.max_by("value", "__o").alias("latest"),
        F.min("ts").alias("first_time"),
        F.max("ts").alias("last_time"),
    )
    return stats.join(exact_quantiles(samples, [name], "value", {"median": 0.5}), name)


def windowed_statistics(samples: DataFrame, window: str, slide: str | None = None, name: str = "name") -> DataFrame:
    """Per window of event time; the same call serves a stream with a watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return samples.groupBy(name, w.alias("w")).agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    ).select(name, F.col("w.start").alias("start"), "count", "min", "max", "mean")


def alert_counts(alerts: DataFrame) -> DataFrame:
    """By status and severity, with totals."""
    return alerts.cube("status", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def error_rate(events: DataFrame, is_error, window: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(flag(is_error)).alias("errors")
    ).select(F.col("w.start").alias("start"), "events", "errors", (F.col("errors") / F.col("events")).alias("error_rate"))


def breaches(samples: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """Samples past the threshold of a rule on their metric.

    ``rules`` hold (rule_id, name, op, threshold, severity); the join is by metric name.
    """
    over = (
        ((F.col("op") == ">") & (F.col("value") > F.col("threshold")))
        | ((F.col("op") == ">=") & (F.col("value") >= F.col("threshold")))
        | ((F.col("op") == "<") & (F.col("value") < F.col("threshold")))
        | ((F.col("op") == "<=") & (F.col("value") <= F.col("threshold")))
    )
    return samples.join(rules.withColumnRenamed("name", name), name).where(over)


def ticks(breached: DataFrame, tick_seconds: int) -> DataFrame:
    """Rule breaches per clock tick: a rule is looked at once a tick, as a monitor loop
    does; (rule_id, tick, samples)."""
    tick = (F.floor(F.unix_timestamp("ts") / tick_seconds) * tick_seconds).cast("bigint")
    return breached.groupBy("rule_id", tick.alias("tick")).agg(F.count(F.lit(1)).alias("samples"))


def cool_down(ticked: DataFrame, seconds: int = 300) -> DataFrame:
    """Ticks on which an alert fires: none fired in the ``seconds`` before."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tick")
        fired, last = [], None
        for t in frame["tick"].to_numpy():
            fire = last is None or t - last >= seconds
            fired.append(fire)
            last = t if fire else last
        return frame[fired]

    return ticked.groupBy("rule_id").applyInPandas(walk, ticked.schema)


def latest_rows(history: DataFrame, ts: str, limit: int, conditions: Sequence = ()) -> DataFrame:
    """Most recent rows of a history that meet the conditions."""
    for cond in conditions:
        history = history.where(cond)
    return history.orderBy(F.desc(ts)).limit(limit)


def push_batches(events: DataFrame, subscriptions: DataFrame, fields: Sequence[str], interval: str, order: str) -> DataFrame:
    """Newest event per subscription and interval: what each subscriber is sent."""
    from tidemark.operators.predicates import subscribed

    fanned = subscribed(events, subscriptions, fields)
    return fanned.groupBy("subscription_id", F.window("ts", interval).start.alias("pushed_at")).agg(
        F.max_by("value", order).alias("value"), F.max(order).alias(order), F.count(F.lit(1)).alias("events")
    )
