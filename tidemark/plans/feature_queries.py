"""Feature queries over the derived daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import ewm_means, ordered, rolling_correlation, snap
from tidemark.operators.features import (
    FeatureBook,
    cross_rank,
    cross_zscore,
    industry_neutral,
    interact,
)
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, WS, avg_rank, div, ewm, lag, roll
from tidemark.plans.sql import snap as s
from tidemark.sources.bars import daily_bars, minute_bars

BOOK = FeatureBook()


def _features(spark, folder, names, places=6):
    df = BOOK.compute(daily_bars(spark, folder), names)
    return df.select("symbol", "date", *[snap(F.col(n), places).alias(n) for n in names])


@query(
    "bars_daily",
    f"WITH {BARS} SELECT symbol, date, {s('open')} AS open, {s('high')} AS high, {s('low')} AS low,"
    f" {s('close')} AS close, volume, {s('amount', 2)} AS amount FROM bars",
)
def bars_daily(spark, folder):
    b = daily_bars(spark, folder)
    return b.select(
        "symbol",
        "date",
        *[snap(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        "volume",
        snap(F.col("amount"), 2).alias("amount"),
    )


@query(
    "bars_minute",
    f"""
    SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS datetime,
      {s('arg_min(value, row(ts, event_id))')} AS open, {s('max(value)')} AS high, {s('min(value)')} AS low,
      {s('arg_max(value, row(ts, event_id))')} AS close, count(*) AS volume, {s('sum(value)', 2)} AS amount
    FROM events GROUP BY 1, 2""",
)
def bars_minute(spark, folder):
    b = minute_bars(spark, folder)
    return b.select(
        "symbol",
        F.col("datetime").cast("timestamp_ntz").alias("datetime"),
        *[snap(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        "volume",
        snap(F.col("amount"), 2).alias("amount"),
    )


_PREV = lag("close")


@query(
    "feature_price",
    f"""WITH {BARS} SELECT symbol, date,
      {s(div('close', _PREV) + ' - 1')} AS returns, {s(f'ln({div("close", _PREV)})')} AS log_returns,
      {s(f'close - {_PREV}')} AS price_change, {s(div('close', _PREV))} AS price_ratio,
      {s(div('high', 'low'))} AS high_low_ratio, {s(div('close', 'high'))} AS close_to_high,
      {s(div('close', 'low'))} AS close_to_low FROM bars""",
)
def feature_price(spark, folder):
    return _features(
        spark,
        folder,
        ["returns", "log_returns", "price_change", "price_ratio", "high_low_ratio", "close_to_high", "close_to_low"],
    )


@query(
    "feature_volume",
    f"""WITH {BARS}, signed AS (SELECT *, sign(close - {_PREV}) * volume AS sv FROM bars)
    SELECT symbol, date, {s(div('volume', lag('volume')) + ' - 1')} AS volume_change,
      {s(div('volume', lag('volume')))} AS volume_ratio, {s(roll('avg', 'volume', 20))} AS volume_ma,
      {s(roll('stddev_samp', 'volume', 20), 4)} AS volume_std,
      {s(div(roll('sum', 'close * volume', 20), roll('sum', 'volume', 20)))} AS vwap,
      {s(roll('sum', 'sv', 20))} AS volume_price_trend FROM signed""",
)
def feature_volume(spark, folder):
    names = ["volume_change", "volume_ratio", "volume_ma", "volume_std", "vwap", "volume_price_trend"]
    df = BOOK.compute(daily_bars(spark, folder), names)
    return df.select(
        "symbol", "date", *[snap(F.col(n), 4 if n == "volume_std" else 6).alias(n) for n in names]
    )


_UP = roll("avg", "gain", 14)
_DOWN = roll("avg", "loss", 14)
_RSI = (
    f"CASE WHEN {_DOWN} = 0 AND {_UP} > 0 THEN 100 WHEN {_DOWN} = 0 THEN NULL"
    f" ELSE 100 - 100 / (1 + {div(_UP, _DOWN)}) END"
)
MOVES = f"""moves AS (SELECT *, greatest(coalesce(close - {_PREV}, 0), 0) AS gain,
  greatest(coalesce({_PREV} - close, 0), 0) AS loss,
  greatest(high - low, abs(high - {_PREV}), abs(low - {_PREV})) AS tr FROM bars)"""


@query(
    "feature_moving_average",
    f"""WITH {BARS} SELECT symbol, date, {s(roll('avg', 'close', 20))} AS sma,
      {s(roll('avg', 'close', 20))} AS bollinger_middle,
      {s(roll('avg', 'close', 20) + ' + 2 * ' + roll('stddev_samp', 'close', 20))} AS bollinger_upper,
      {s(roll('avg', 'close', 20) + ' - 2 * ' + roll('stddev_samp', 'close', 20))} AS bollinger_lower,
      {s(div('4 * ' + roll('stddev_samp', 'close', 20), roll('avg', 'close', 20)))} AS bollinger_bandwidth,
      {s(div('close', lag('close', 10)) + ' - 1')} AS momentum FROM bars""",
)
def feature_moving_average(spark, folder):
    return _features(
        spark,
        folder,
        ["sma", "bollinger_middle", "bollinger_upper", "bollinger_lower", "bollinger_bandwidth", "momentum"],
    )


@query(
    "feature_oscillators",
    f"""WITH {BARS}, {MOVES}, k AS (SELECT *, 100 * {div(
        'close - ' + roll('min', 'low', 14), roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS k FROM moves)
    SELECT symbol, date, {s(_RSI, 5)} AS rsi, {s('k')} AS stochastic_k,
      {s(f'CASE WHEN count(k) OVER ({WS} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 1 THEN avg(k) OVER ({WS} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END')} AS stochastic_d,
      {s(roll('avg', 'tr', 14))} AS atr FROM k""",
)
def feature_oscillators(spark, folder):
    names = ["rsi", "stochastic_k", "stochastic_d", "atr"]
    df = BOOK.compute(daily_bars(spark, folder), names)
    return df.select("symbol", "date", *[snap(F.col(n), 5 if n == "rsi" else 6).alias(n) for n in names])


@query(
    "feature_exponential",
    f"""WITH {BARS}, e AS (SELECT symbol, date, {ewm('close', 20)} AS ema, {ewm('close', 200)} AS long, {ewm('close', 12)} - {ewm('close', 26)} AS macd
      FROM bars), g AS (SELECT *, {ewm('macd', 9)} AS sig FROM e)
    SELECT symbol, date, {s('ema', 5)} AS ema, {s('macd', 5)} AS macd, {s('sig', 5)} AS macd_signal,
      {s('macd - sig', 5)} AS macd_histogram, {s('long', 5)} AS ema_200 FROM g""",
)
def feature_exponential(spark, folder):
    names = ["ema", "macd", "macd_signal", "macd_histogram"]
    df = ewm_means(BOOK.compute(daily_bars(spark, folder), names), ordered(["symbol"], ["date"]), {"ema_200": ("close", 200)})
    return df.select("symbol", "date", *[snap(F.col(n), 5).alias(n) for n in [*names, "ema_200"]])


@query(
    "feature_isolated",
    f"WITH {BARS} SELECT symbol, date, {s(roll('avg', 'close', 20))} AS sma, 'absent column, failing builder, unknown name' AS failed FROM bars",
)
def feature_isolated(spark, folder):
    """Three features that cannot be built do not keep the fourth from being computed."""
    book = FeatureBook()
    book.register("absent column", lambda w: F.col("no_such_column").cast("double"), ["close"])
    book.register("failing builder", lambda w: F.lit(1 / 0), ["close"])
    out, failed = book.compute_isolated(daily_bars(spark, folder), ["absent column", "sma", "failing builder", "unknown name"])
    return out.select("symbol", "date", snap(F.col("sma")).alias("sma"), F.lit(", ".join(sorted(failed))).alias("failed"))


@query(
    "cross_section_rank",
    f"""WITH {BARS} SELECT symbol, date, {s(avg_rank('volume', 'date'))} AS volume_rank,
      {s(div(avg_rank('volume', 'date'), 'count(volume) OVER (PARTITION BY date)'))} AS volume_pct,
      {s('1 + count(*) OVER (PARTITION BY date) - ' + avg_rank('volume', 'date'))} AS volume_rank_desc,
      {s(div('close - avg(close) OVER (PARTITION BY date)', 'stddev_samp(close) OVER (PARTITION BY date)'))} AS close_z
    FROM bars""",
)
def cross_section_rank(spark, folder):
    df = daily_bars(spark, folder)
    df = cross_rank(df, "volume", "volume_rank")
    df = cross_rank(df, "volume", "volume_pct", pct=True)
    df = cross_rank(df, "volume", "volume_rank_desc", ascending=False)
    df = cross_zscore(df, "close", "close_z")
    return df.select(
        "symbol", "date", *[snap(F.col(c)).alias(c) for c in ("volume_rank", "volume_pct", "volume_rank_desc", "close_z")]
    )


@query(
    "cross_section_industry_neutral",
    f"""WITH {BARS}, b AS (SELECT *, CAST(split_part(symbol, '#', 2) AS INT) % 5 AS industry FROM bars)
    SELECT symbol, date, industry,
      {s('CASE WHEN count(*) OVER (PARTITION BY date, industry) > 1 AND stddev_samp(close) OVER (PARTITION BY date, industry) > 0 THEN (close - avg(close) OVER (PARTITION BY date, industry)) / stddev_samp(close) OVER (PARTITION BY date, industry) ELSE close END')} AS neutral
    FROM b""",
)
def cross_section_industry_neutral(spark, folder):
    df = daily_bars(spark, folder).withColumn(
        "industry", F.split("symbol", "#")[1].cast("int") % 5
    )
    df = industry_neutral(df, "close", "industry", "neutral")
    return df.select("symbol", "date", "industry", snap(F.col("neutral")).alias("neutral"))


@query(
    "feature_interactions",
    f"""WITH {BARS} SELECT symbol, date, {s('close * volume', 4)} AS multiply, {s(div('close', 'volume'))} AS divide,
      {s('high + low')} AS add, {s('high - low')} AS subtract FROM bars""",
)
def feature_interactions(spark, folder):
    b = daily_bars(spark, folder)
    return b.select(
        "symbol",
        "date",
        snap(interact("close", "volume", "multiply"), 4).alias("multiply"),
        snap(interact("close", "volume", "divide")).alias("divide"),
        snap(interact("high", "low", "add")).alias("add"),
        snap(interact("high", "low", "subtract")).alias("subtract"),
    )


@query(
    "feature_rolling_correlation",
    f"""WITH {BARS} SELECT symbol, date,
      {s(f'CASE WHEN count(close) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN corr(close, volume) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END')} AS close_volume_corr
    FROM bars""",
)
def feature_rolling_correlation(spark, folder):
    df = rolling_correlation(
        daily_bars(spark, folder), "close", "volume", "close_volume_corr", ["symbol"], ["date"], 20
    )
    return df.select("symbol", "date", snap(F.col("close_volume_corr")).alias("close_volume_corr"))


@query(
    "feature_custom",
    f"""WITH {BARS} SELECT symbol, date, {s(div('high - low', roll('avg', 'close', 5)))} AS range_share FROM bars""",
)
def feature_custom(spark, folder):
    from tidemark.columns import ratio, roll_mean

    book = FeatureBook()
    book.register(
        "range_share",
        lambda w: ratio(F.col("high") - F.col("low"), roll_mean(F.col("close"), w, 5)),
        needs=["high", "low", "close"],
    )
    df = book.compute(daily_bars(spark, folder), ["range_share"])
    return df.select("symbol", "date", snap(F.col("range_share")).alias("range_share"))


@query(
    "feature_minute_bars",
    f"""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS date,
        arg_max(value, row(ts, event_id)) AS close FROM events GROUP BY 1, 2)
    SELECT symbol, date AS datetime, {s(roll('avg', 'close', 20))} AS sma, {s(div('close', lag('close')) + ' - 1', 5)} AS returns
    FROM b""",
)
def feature_minute_bars(spark, folder):
    """The series of a symbol is bounded by the minutes of the calendar."""
    df = BOOK.compute(minute_bars(spark, folder), ["sma", "returns"], order=("datetime",))
    return df.select(
        "symbol",
        F.col("datetime").cast("timestamp_ntz").alias("datetime"),
        snap(F.col("sma")).alias("sma"),
        snap(F.col("returns"), 5).alias("returns"),
    )
