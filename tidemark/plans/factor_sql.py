"""Checking SQL for the factor panel."""

from tidemark.plans.sql import BARS, WS, div, lag, roll

_P = lag("close")
_UP, _DOWN = roll("avg", "gain", 14), roll("avg", "loss", 14)
_RSI = (
    f"(CASE WHEN {_DOWN} = 0 AND {_UP} > 0 THEN 100 WHEN {_DOWN} = 0 THEN NULL"
    f" ELSE 100 - 100 / (1 + {div(_UP, _DOWN)}) END)"
)
FACTORS = f"""{BARS},
moves AS (SELECT *, {div('close', _P)} - 1 AS ret, greatest(coalesce(close - {_P}, 0), 0) AS gain,
  greatest(coalesce({_P} - close, 0), 0) AS loss FROM bars),
fac AS (SELECT symbol, date, close, volume, ret,
  {div('close', lag('close', 20))} - 1 AS momentum_20d,
  {div('close - ' + roll('avg', 'close', 10), roll('avg', 'close', 10))} AS mean_reversion_10d,
  {roll('stddev_samp', 'ret', 20)} * sqrt(252) AS volatility_20d,
  {div('volume', roll('avg', 'volume', 20))} AS volume_ratio_20d,
  ({_RSI} - 50) / 50 AS rsi_14d,
  {div(f'lead(close) OVER ({WS})', 'close')} - 1 AS fwd_ret FROM moves)"""
NAMES = ("momentum_20d", "mean_reversion_10d", "volatility_20d", "volume_ratio_20d", "rsi_14d")
PANEL = (
    FACTORS
    + ",\npanel AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS factor_id, symbol, date, {n} AS value, fwd_ret FROM fac" for n in NAMES)
    + "),\npairs AS (SELECT * FROM panel WHERE value IS NOT NULL AND fwd_ret IS NOT NULL)"
)
SERIES = "PARTITION BY factor_id, symbol"
BUCKETS = f"""{PANEL},
sized AS (SELECT *, row_number() OVER ({SERIES} ORDER BY value, date) AS rn,
  floor(count(*) OVER ({SERIES}) / 5.0) AS size FROM pairs),
buckets AS (SELECT *, CAST(least(floor((rn - 1) / size), 4) AS INT) AS bucket FROM sized WHERE size > 0),
placed AS (SELECT *, CAST(rn - 1 - bucket * size AS INT) AS pos FROM buckets),
qs AS (SELECT factor_id, symbol, avg(fwd_ret) FILTER (bucket = 0) AS q1, avg(fwd_ret) FILTER (bucket = 1) AS q2,
  avg(fwd_ret) FILTER (bucket = 2) AS q3, avg(fwd_ret) FILTER (bucket = 3) AS q4,
  avg(fwd_ret) FILTER (bucket = 4) AS q5 FROM placed GROUP BY 1, 2)"""
