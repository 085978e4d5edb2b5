"""Daily and minute bars from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import events, table


def trade_order() -> Column:
    """Total order of the trades of one day as one decimal.

    A decimal of fixed width lives in the hash-aggregate buffer; a struct would make
    Spark sort every raw row before the partial aggregate.
    """
    low = (
        F.col("l_linenumber").cast("bigint") * F.lit(10**17)
        + F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.lit(1000)
        + F.col("l_quantity").cast("bigint")
    )
    high = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    return (high + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (symbol, date): the raw trades shrink to at most one row per
    calendar day before any window sees them, however hot a symbol is."""
    trades = table(spark, folder, "lineitem").select(
        "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", trade_order().alias("seq")
    )
    names = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")
    )
    priced = trades.join(names, "l_partkey").withColumn(
        "price", F.col("l_extendedprice") / F.col("l_quantity")
    )
    return priced.groupBy("symbol", F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def minute_bars(spark: SparkSession, folder: str, period: int = 5) -> DataFrame:
    """Bars of ``events.value`` per event type and period of minutes."""
    order = (
        F.unix_micros("ts").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
        + F.col("event_id").cast("decimal(19,0)")
    ).cast("decimal(38,0)")
    return (
        events(spark, folder)
        .select("event_type", "ts", "value", order.alias("seq"))
        .groupBy(F.col("event_type").alias("symbol"), F.window("ts", f"{period} minutes").start.alias("datetime"))
        .agg(
            F.min_by("value", "seq").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "seq").alias("close"),
            F.count(F.lit(1)).alias("volume"),
            F.sum("value").alias("amount"),
        )
        .withColumn("period", F.lit(period))
    )


def landed_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar-shaped row per trade, with the faults the quality rules look for.

    Several rows share a day, some prices are zero or negative, some highs lie below
    the open, and some volumes are empty or zero: all by rules on the trade's columns.
    """
    c = F.col
    trades = table(spark, folder, "lineitem").withColumn("seq", trade_order())
    names = table(spark, folder, "part").select(c("p_partkey").alias("l_partkey"), c("p_brand").alias("symbol"))
    base = c("l_extendedprice") / c("l_quantity")
    price = F.when(c("l_quantity") == 13, 0.0).when((c("l_linenumber") == 7) & (c("l_tax") == 0.08), -base).otherwise(base)
    volume = F.when((c("l_returnflag") == "N") & (c("l_linenumber") == 1), None).when(
        c("l_discount") == 0.0, 0.0
    ).otherwise(c("l_quantity"))
    return (
        trades.join(names, "l_partkey")
        .withColumn("price", price)
        .select(
            "symbol",
            F.to_date("l_shipdate").alias("date"),
            (c("price") * (1.05 - c("l_discount"))).alias("open"),
            (c("price") * (1 + c("l_discount"))).alias("high"),
            (c("price") * (1 - c("l_tax"))).alias("low"),
            (c("price") * (1 + c("l_discount") - c("l_tax"))).alias("close"),
            volume.alias("volume"),
            "seq",
        )
    )
