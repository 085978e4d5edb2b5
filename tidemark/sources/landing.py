"""Landed vendor files to standard frames: rename, coerce, check, order, project."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.symbols import exchange_of, standard_symbol
from tidemark.functions.values import BAR_COLUMNS, rename, to_numbers

NUMBERS = ("open", "high", "low", "close", "volume", "amount", "price", "pct_chg", "change", "turnover")


class MissingColumns(ValueError):
    """A landed frame lacks columns its kind must have."""


def read_landed(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """CSV, JSON or Parquet as landed; text formats take an explicit schema."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns {lacking}")
    return df


def daily_frame(landed: DataFrame, names: Mapping[str, str] = BAR_COLUMNS) -> DataFrame:
    """Standard daily bars; text that is no number becomes null, copies go."""
    df = require(rename(landed, names), ["symbol", "date", "open", "high", "low", "close", "volume"])
    df = to_numbers(df, NUMBERS).withColumn("date", F.to_date(F.col("date").cast("string")))
    df = df.withColumn("symbol", standard_symbol(F.col("symbol")))
    # a midnight in Shanghai lies on the day before in UTC: the date stays, the instant is kept beside it
    df = df.withColumn("ts_utc", F.to_utc_timestamp(F.col("date").cast("timestamp"), "Asia/Shanghai"))
    keep = [c for c in ("symbol", "date", "ts_utc", "open", "high", "low", "close", "volume", "amount") if c in df.columns]
    return df.select(*keep).dropDuplicates()


def minute_frame(landed: DataFrame, start=None, end=None, names: Mapping[str, str] = BAR_COLUMNS) -> DataFrame:
    df = require(rename(landed, names), ["symbol", "datetime", "open", "high", "low", "close", "volume"])
    df = to_numbers(df, NUMBERS).withColumn(
        "datetime", F.to_utc_timestamp(F.col("datetime").cast("timestamp"), "Asia/Shanghai")
    )
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end).cast("timestamp"))
    return df.withColumn("symbol", standard_symbol(F.col("symbol"))).dropDuplicates()


def stock_list(landed: DataFrame, names: Mapping[str, str] = BAR_COLUMNS) -> DataFrame:
    df = require(rename(landed, names), ["symbol", "name"])
    df = df.withColumn("symbol", standard_symbol(F.col("symbol")))
    return df.withColumn("exchange", exchange_of(F.col("symbol")))


def quotes(landed: DataFrame, symbols: Sequence[str] | None, stamped_at, names: Mapping[str, str] = BAR_COLUMNS) -> DataFrame:
    df = to_numbers(rename(landed, names), NUMBERS).withColumn("symbol", standard_symbol(F.col("symbol")))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    return df.withColumn("timestamp", F.lit(stamped_at).cast("timestamp"))


def filtered(landed: DataFrame, key: str, wanted: Sequence[str] | None, date: str | None = None, start=None, end=None) -> DataFrame:
    """Index, info, sector and macro landings: membership and date range."""
    df = landed
    if wanted is not None:
        df = df.where(F.col(key).isin(list(wanted)))
    if date is not None and start is not None:
        df = df.where(F.col(date).between(start, end))
    return df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def backtest_prices(bars: DataFrame) -> DataFrame:
    return bars.select("date", "close", "symbol").sortWithinPartitions("symbol", "date")


def futures_frame(landed: DataFrame, names: Mapping[str, str], max_null: float = 0.10) -> DataFrame:
    """Contracts whose close is empty on more than ``max_null`` of their rows are left out."""
    df = to_numbers(require(rename(landed, names), ["symbol", "date", "open", "high", "low", "close", "volume"]), NUMBERS)
    sound = df.groupBy("symbol").agg(F.avg(F.col("close").isNull().cast("int")).alias("__e")).where(F.col("__e") <= max_null)
    return df.join(sound.select("symbol"), "symbol", "left_semi")
