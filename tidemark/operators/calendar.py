"""Trading calendar. A calendar holds one row per trading day: 250 a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trading_days(days: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Distinct dates in the years asked for."""
    out = days.select(F.to_date("date").alias("date")).where(F.col("date").isNotNull())
    if first_year is not None:
        out = out.where(F.year("date") >= first_year)
    if last_year is not None:
        out = out.where(F.year("date") <= last_year)
    return out.distinct()


def weekday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Monday to Friday of the years, where no calendar is at hand."""
    span = spark.range(1).select(
        F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("date")
    )
    return span.where(F.weekday("date") < 5)


def between(calendar: DataFrame, start, end) -> DataFrame:
    return calendar.where(F.col("date").between(start, end))


def neighbours(calendar: DataFrame, search_days: int = 10) -> DataFrame:
    """Every day of the span with the next and previous trading day.

    The search ends after ``search_days`` days; then the next weekday stands in.
    """
    d = F.col("date")
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence(F.date_sub("a", 1), F.date_add("b", 1))).alias("date")
    )
    w = Window.orderBy("date")
    days = span.join(calendar.select("date", F.col("date").alias("open")), "date", "left")
    after = F.first("open", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step_on = F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1)
    step_back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return days.withColumns({"__a": after, "__b": before}).select(
        "date",
        F.col("open").isNotNull().alias("is_open"),
        F.when(F.datediff("__a", "date") <= search_days, F.col("__a")).otherwise(F.date_add(d, step_on)).alias("next_day"),
        F.when(F.datediff("date", "__b") <= search_days, F.col("__b")).otherwise(F.date_sub(d, step_back)).alias("prev_day"),
    )


def on_trading_days(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date is a trading day."""
    days = calendar.select(F.col("date").alias(date)).distinct()
    return df.join(days, date, "left_semi")


def indexed(calendar: DataFrame) -> DataFrame:
    """Dates with their position; the only global window, over calendar days."""
    return calendar.withColumn("idx", F.row_number().over(Window.orderBy("date")))
