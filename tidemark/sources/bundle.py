"""Export bundle: calendar, instruments and feature tables, with update and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.symbols import exchange_of, standard_symbol, to_prefixed

FIELDS = ("open", "high", "low", "close", "volume")
# Span written for every instrument.
FIRST_DAY, LAST_DAY = "2018-01-01", "2030-12-31"


def any_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD``."""
    t = text.cast("string")
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "yyyyMMdd"))


def calendar_lines(dates: DataFrame) -> DataFrame:
    return dates.select(any_date(F.col("date")).alias("date")).where(F.col("date").isNotNull()).distinct()


def instrument_rows(symbols: DataFrame) -> DataFrame:
    """Prefixed symbols with the fixed span; other exchanges are skipped."""
    code = to_prefixed(standard_symbol(F.col("symbol")))
    return (
        symbols.select(code.alias("instrument"))
        .where(F.col("instrument").isNotNull())
        .distinct()
        .select("instrument", F.lit(FIRST_DAY).alias("start_date"), F.lit(LAST_DAY).alias("end_date"))
    )


def feature_rows(bars: DataFrame) -> DataFrame:
    """Float fields named with a dollar sign, gaps as 0, dates in epoch seconds."""
    present = [f for f in FIELDS if f in bars.columns]
    if len(present) < 4:
        raise ValueError(f"need four of {FIELDS}, got {present}")
    number = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float")
    factor = F.col("factor") if "factor" in bars.columns else F.lit(1.0)
    return bars.select(
        to_prefixed(standard_symbol(F.col("symbol"))).alias("instrument"),
        F.unix_timestamp(F.col("date").cast("timestamp")).alias("epoch"),
        *[number(F.col(f)).alias(f"${f}") for f in present],
        number(factor).alias("$factor"),
    )


def build(spark: SparkSession, bars: DataFrame, requested: DataFrame, folder: str) -> DataFrame:
    """Write the three parts; return requested, written and failed counts."""
    calendar_lines(bars.select("date")).coalesce(1).sortWithinPartitions("date").select(
        F.date_format("date", "yyyy-MM-dd").alias("value")
    ).write.mode("overwrite").text(f"{folder}/calendar")
    instrument_rows(requested).coalesce(1).sortWithinPartitions("instrument").write.mode("overwrite").option(
        "sep", "\t"
    ).csv(f"{folder}/instruments")
    _write_features(feature_rows(bars.join(requested.select("symbol").distinct(), "symbol", "left_semi")), folder, "overwrite")
    asked = requested.select(to_prefixed(standard_symbol(F.col("symbol"))).alias("instrument")).distinct()
    done = spark.read.parquet(f"{folder}/features").select("instrument", F.lit(1).alias("__d")).distinct()
    return asked.join(done, "instrument", "left").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("__d").alias("written"),
        (F.count(F.lit(1)) - F.count("__d")).alias("failed"),
    )


def _write_features(rows: DataFrame, folder: str, mode: str) -> None:
    rows = rows.withColumn("market", F.substring("instrument", 1, 2))
    rows.hint("rebalance", "market").sortWithinPartitions("market", "instrument", "epoch").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("market").parquet(f"{folder}/features")


def update(spark: SparkSession, folder: str, target: str, bars: DataFrame, symbols: DataFrame) -> None:
    """Old and new dates and symbols joined; the rows of the given symbols replaced.

    The new state is written beside the old one, so readers of the old never break.
    """
    old_days = spark.read.text(f"{folder}/calendar").select(F.col("value").alias("date"))
    calendar_lines(old_days.union(bars.select(F.col("date").cast("string")))).coalesce(1).sortWithinPartitions("date").select(
        F.date_format("date", "yyyy-MM-dd").alias("value")
    ).write.mode("overwrite").text(f"{target}/calendar")
    schema = "instrument string, start_date string, end_date string"
    old = spark.read.option("sep", "\t").schema(schema).csv(f"{folder}/instruments")
    old.union(instrument_rows(symbols)).distinct().coalesce(1).sortWithinPartitions("instrument").write.mode("overwrite").option(
        "sep", "\t"
    ).csv(f"{target}/instruments")
    new = feature_rows(bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi"))
    stored = spark.read.parquet(f"{folder}/features").drop("market")
    stay = stored.join(new.select("instrument").distinct(), "instrument", "left_anti")
    _write_features(stay.unionByName(new), target, "overwrite")


def validate(spark: SparkSession, folder: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Counts of the parts, instruments without rows, and whether fields are missing."""
    days = spark.read.text(f"{folder}/calendar")
    names = spark.read.option("sep", "\t").csv(f"{folder}/instruments").select(F.col("_c0").alias("instrument"))
    rows = spark.read.parquet(f"{folder}/features")
    lacking = [f for f in fields if f"${f}" not in rows.columns]
    absent = names.join(rows.select("instrument").distinct(), "instrument", "left_anti")
    counted = {"instruments": names, "rows": rows, "empty_instruments": absent}
    out = days.agg(F.count(F.lit(1)).alias("days")).withColumns(
        {name: df.agg(F.count(F.lit(1)).alias(name)).scalar() for name, df in counted.items()}
    )
    return out.withColumns(
        {
            "missing_fields": F.array(*[F.lit(f) for f in lacking]).cast("array<string>"),
            "valid": (F.col("days") > 0) & (F.col("instruments") > 0) & (F.col("rows") > 0) & F.lit(not lacking),
        }
    )
