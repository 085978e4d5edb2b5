"""Data points: (symbol, timestamp, data_type, source, values map, quality score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def to_points(
    df: DataFrame, symbol: Column, timestamp: Column, fields: Sequence[str], data_type: str, source: Column, batch: str | None = None
) -> DataFrame:
    """Landed columns to points; text that is no number is kept in ``texts``."""
    numbers = F.map_from_arrays(
        F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).try_cast("double") for f in fields])
    )
    texts = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(f) for f in fields]),
            F.array(*[F.when(F.col(f).try_cast("double").isNull(), F.col(f).cast("string")) for f in fields]),
        ),
        lambda k, v: v.isNotNull(),
    )
    return df.select(
        symbol.alias("symbol"),
        timestamp.alias("timestamp"),
        F.lit(data_type).alias("data_type"),
        source.alias("source"),
        numbers.alias("values"),
        texts.alias("texts"),
        F.lit(1.0).alias("quality_score"),
        F.lit(batch).alias("batch_id"),
    )


def flatten(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Map entries back to columns."""
    return points.select("symbol", "timestamp", *[F.col("values")[f].alias(f) for f in fields])


def news_points(news: DataFrame, symbols: Sequence[str], keywords: Sequence[str], limit: int | None = None) -> DataFrame:
    """News rows that name one of the symbols and one of the keywords."""
    body = F.concat_ws(" ", "content", "title")

    def any_of(words: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: body.contains(w))

    kept = news
    if symbols:
        kept = kept.where(any_of(symbols))
    if keywords:
        kept = kept.where(any_of(keywords))
    if limit is not None:
        kept = kept.orderBy("id").limit(limit)
    return kept


def trade_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points from the trades; some rows lack fields or break the price rules."""
    c = F.col
    price = c("l_extendedprice") / c("l_quantity") / 10
    t = table(spark, folder, "lineitem").select(
        F.when(c("l_quantity") == 50, None).otherwise(F.concat(F.lit("P"), c("l_partkey").cast("string"))).alias("symbol"),
        c("l_shipdate").cast("timestamp").alias("timestamp"),
        F.when(c("l_linestatus") == "O", "akshare").otherwise("tushare").alias("source"),
        (price * (1.05 - c("l_discount"))).alias("open"),
        (price * (1 + c("l_discount"))).alias("high"),
        (price * (1 - c("l_tax"))).alias("low"),
        (price * (1 + c("l_discount") - c("l_tax"))).alias("close"),
        F.when(c("l_returnflag") == "R", None).otherwise(c("l_quantity")).alias("volume"),
        ((c("l_discount") - c("l_tax")) * 300).alias("change_pct"),
    )
    fields = ["open", "high", "low", "close", "volume", "change_pct"]
    return t.select(
        "symbol",
        "timestamp",
        F.lit("stock_price").alias("data_type"),
        "source",
        F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*fields)).alias("values"),
        F.lit(1.0).alias("quality_score"),
    )
