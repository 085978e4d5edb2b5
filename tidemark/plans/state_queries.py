"""Market state, regime and weight queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.columns import ordered, roll_mean, snap
from tidemark.operators import factors as fc
from tidemark.operators import market_state as ms
from tidemark.operators import portfolio as pf
from tidemark.operators import regimes as rg
from tidemark.operators import weights as wt
from tidemark.plans.factor_sql import FACTORS, NAMES
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, WS, div, ewm, lag, roll
from tidemark.plans.sql import snap as s
from tidemark.session import cut_lineage
from tidemark.sources.bars import daily_bars


def smooth_bars(spark, folder):
    """Bars with the 60-row mean as close: the derived prices are noise, their mean moves
    like a market."""
    w = ordered(["symbol"], ["date"])
    b = daily_bars(spark, folder).withColumn("close", roll_mean(F.col("close"), w, 60))
    return b.where(F.col("close").isNotNull()).select("symbol", "date", "close", "volume")


SMOOTH = f"""{BARS}, sm0 AS (SELECT symbol, date, {roll('avg', 'close', 60)} AS close, volume FROM bars), sm AS (SELECT * FROM sm0 WHERE close IS NOT NULL),
mv AS (SELECT *, row_number() OVER ({WS}) AS rn, {div('close', lag('close'))} - 1 AS ret, greatest(coalesce(close - {lag('close')}, 0), 0) AS gain,
  greatest(coalesce({lag('close')} - close, 0), 0) AS loss, {ewm('close', 12)} - {ewm('close', 26)} AS md FROM sm)"""
_UP, _DOWN = roll("avg", "gain", 14), roll("avg", "loss", 14)
_RSI = f"(CASE WHEN {_DOWN} = 0 AND {_UP} > 0 THEN 100 WHEN {_DOWN} = 0 THEN NULL ELSE 100 - 100 / (1 + {div(_UP, _DOWN)}) END)"


def _chg(n):
    return f"({div('close', lag('close', n))} - 1)"


def _after(n, x, default):
    return f"CASE WHEN rn > {n} THEN {x} ELSE {default} END"


_M20, _S20, _V5, _V20 = roll("avg", "close", 20), roll("stddev_samp", "close", 20), roll("avg", "volume", 5), roll("avg", "volume", 20)
IND = f"""{SMOOTH}, ind AS (SELECT symbol, date, close, volume, {_after(1, _chg(1), '0')} AS price_change_1d, {_after(5, _chg(5), '0')} AS price_change_5d, {_after(20, _chg(20), '0')} AS price_change_20d,
  {_after(20, roll('stddev_samp', 'ret', 20) + ' * sqrt(252)', '0')} AS realized_volatility, {_after(10, _chg(10), '0')} AS momentum_short, {_after(50, _chg(50), '0')} AS momentum_medium, {_after(200, _chg(200), '0')} AS momentum_long,
  {_after(14, _RSI, '50')} AS rsi, {_after(26, 'md', '0')} AS macd,
  {_after(20, f'CASE WHEN {_S20} > 0 THEN greatest(least((close - ({_M20} - 2 * {_S20})) / (4 * {_S20}), 1), 0) ELSE 0.5 END', '0.5')} AS bollinger_position,
  {_after(20, f'coalesce({div("volume", _V20)}, 1)', '1')} AS volume_ratio, {_after(20, f'coalesce({div(f"{_V5} - {_V20}", _V20)}, 0)', '0')} AS volume_trend FROM mv)"""
_INDICATORS = (
    "price_change_1d price_change_5d price_change_20d realized_volatility momentum_short momentum_medium momentum_long rsi macd "
    "bollinger_position volume_ratio volume_trend"
).split()
_PLACES = {"rsi": 4, "macd": 4}


@query(
    "state_indicators",
    f"WITH {IND} SELECT symbol, date, {', '.join(f'{s(c, _PLACES.get(c, 6))} AS {c}' for c in _INDICATORS)}, {s('CASE WHEN realized_volatility > 0 THEN realized_volatility * 100 ELSE 20 END', 4)} AS vix_level FROM ind",
)
def state_indicators(spark, folder):
    out = ms.indicators(smooth_bars(spark, folder))
    return out.select(
        "symbol", "date", *[snap(F.col(c), _PLACES.get(c, 6)).alias(c) for c in _INDICATORS], snap(F.col("vix_level"), 4).alias("vix_level")
    )


STATES = f"""{IND}, sc AS (SELECT *, CASE WHEN momentum_medium > 0.05 THEN 2 WHEN momentum_medium > 0.02 THEN 1 WHEN momentum_medium < -0.05 THEN -2 WHEN momentum_medium < -0.02 THEN -1 ELSE 0 END
  + CASE WHEN rsi > 70 THEN 1 WHEN rsi < 30 THEN -1 ELSE 0 END + CASE WHEN volume_ratio > 1.2 AND momentum_short > 0 THEN 1 WHEN volume_ratio > 1.2 AND momentum_short < 0 THEN -1 ELSE 0 END AS score FROM ind),
st AS (SELECT *, CASE WHEN realized_volatility > 0.25 THEN CASE WHEN score > 0 THEN 'markup' ELSE 'markdown' END WHEN score >= 3 THEN 'markup' WHEN score >= 1 THEN 'accumulation' WHEN score <= -3 THEN 'markdown' WHEN score <= -1 THEN 'distribution' ELSE 'consolidation' END AS phase,
  CASE WHEN realized_volatility >= 0.5 THEN 'extreme' WHEN realized_volatility >= 0.3 THEN 'high' WHEN realized_volatility >= 0.2 THEN 'normal' ELSE 'low' END AS volatility_regime,
  CASE WHEN momentum_medium >= 0.05 THEN 'strong_uptrend' WHEN momentum_medium >= 0.02 THEN 'uptrend' WHEN momentum_medium <= -0.05 THEN 'strong_downtrend' WHEN momentum_medium <= -0.02 THEN 'downtrend' ELSE 'sideways' END AS trend_direction,
  CASE WHEN volume_ratio > 1.5 AND realized_volatility < 0.15 THEN 'abundant' WHEN (volume_ratio < 0.7 OR realized_volatility > 0.3) AND realized_volatility > 0.4 THEN 'stressed' WHEN volume_ratio < 0.7 OR realized_volatility > 0.3 THEN 'tight' ELSE 'normal' END AS liquidity_condition FROM sc)"""
_RUN = (
    "row_number() OVER ({ws}) - max(CASE WHEN {c} IS NOT DISTINCT FROM prev_{c} AND seq > 1 THEN NULL ELSE seq END) OVER ({ws}) + 1"
)
RUNS = f"""{STATES}, pv AS (SELECT *, row_number() OVER ({WS}) AS seq, {', '.join(f'lag({c}) OVER ({WS}) AS prev_{c}' for c in ('phase', 'volatility_regime', 'trend_direction'))} FROM st)"""


@query(
    "state_full",
    f"WITH {RUNS} SELECT symbol, date, phase, volatility_regime, trend_direction, liquidity_condition, "
    + ", ".join(
        f"CAST({_RUN.format(ws=WS, c=c)} AS INT) AS {n}"
        for c, n in (("phase", "phase_duration"), ("volatility_regime", "volatility_duration"), ("trend_direction", "trend_duration"))
    )
    + " FROM pv",
)
def state_full(spark, folder):
    return ms.states(smooth_bars(spark, folder)).select(
        "symbol", "date", "phase", "volatility_regime", "trend_direction", "liquidity_condition", "phase_duration", "volatility_duration", "trend_duration"
    )


_CONF = f"""{STATES}, c1 AS (SELECT *, CASE WHEN (phase IN ('markup', 'accumulation') AND momentum_medium > 0) OR (phase IN ('markdown', 'distribution') AND momentum_medium < 0) THEN least(abs(momentum_medium) * 10, 1) END AS k1,
  CASE WHEN phase = 'markup' AND rsi > 50 THEN (rsi - 50) / 50 WHEN phase = 'markdown' AND rsi < 50 THEN (50 - rsi) / 50 END AS k2 FROM st),
c2 AS (SELECT *, CASE WHEN k1 IS NULL AND k2 IS NULL THEN 0.5 ELSE (coalesce(k1, 0) + coalesce(k2, 0)) / ((k1 IS NOT NULL)::INT + (k2 IS NOT NULL)::INT) END AS phase_confidence,
  CASE volatility_regime WHEN 'low' THEN greatest(0, 1 - realized_volatility / 0.1) WHEN 'normal' THEN 0.5 WHEN 'high' THEN 0.5 ELSE least(1, realized_volatility / 0.5) END AS volatility_confidence,
  CASE WHEN trend_direction LIKE 'strong%' THEN least(1, abs(momentum_medium) / 0.05) WHEN trend_direction <> 'sideways' THEN least(1, abs(momentum_medium) / 0.025) ELSE greatest(0, 1 - abs(momentum_medium) * 10) END AS trend_confidence,
  CASE liquidity_condition WHEN 'abundant' THEN least(1, volume_ratio / 1.5) * greatest(0, 1 - realized_volatility / 0.15) WHEN 'stressed' THEN least(1, realized_volatility / 0.4) ELSE 0.7 END AS liquidity_confidence FROM c1)"""
_CONFS = ("phase_confidence", "volatility_confidence", "trend_confidence", "liquidity_confidence")


@query(
    "state_confidence",
    f"WITH {_CONF} SELECT symbol, date, {', '.join(f'{s(c, 5)} AS {c}' for c in _CONFS)}, {s('coalesce(list_avg(list_filter([phase_confidence, volatility_confidence, trend_confidence, liquidity_confidence], lambda x: x > 0)), 0)', 5)} AS overall_confidence FROM c2",
)
def state_confidence(spark, folder):
    out = ms.states(smooth_bars(spark, folder))
    return out.select("symbol", "date", *[snap(F.col(c), 5).alias(c) for c in (*_CONFS, "overall_confidence")])


@query(
    "state_signals",
    f"""WITH {STATES} SELECT symbol, date, array_to_string(list_filter([CASE WHEN rsi > 80 THEN 'rsi_overbought' WHEN rsi < 20 THEN 'rsi_oversold' END,
      CASE WHEN realized_volatility > 0.35 THEN 'volatility_surge' WHEN realized_volatility < 0.08 THEN 'volatility_very_low' END,
      CASE WHEN volume_ratio > 2 THEN 'volume_surge' WHEN volume_ratio < 0.5 THEN 'volume_shrink' END, CASE WHEN momentum_short * momentum_medium < 0 THEN 'momentum_divergence' END], lambda x: x IS NOT NULL), ',') AS signals,
      CASE phase {' '.join(f"WHEN '{p}' THEN {c.get('markup', 'NULL')}::DOUBLE" for p, c in ms.NEXT_PHASE.items())} END AS markup_next FROM st""",
)
def state_signals(spark, folder):
    out = ms.states(smooth_bars(spark, folder))
    return out.select("symbol", "date", F.array_join("signals", ",").alias("signals"), F.try_element_at("next_phases", F.lit("markup")).alias("markup_next"))


@query(
    "state_latest",
    f"WITH {STATES} SELECT symbol, max(date) AS date, arg_max(phase, date) AS phase, arg_max(trend_direction, date) AS trend_direction FROM st GROUP BY 1",
)
def state_latest(spark, folder):
    return ms.latest(ms.states(smooth_bars(spark, folder))).select("symbol", "date", "phase", "trend_direction")


@query(
    "state_transitions",
    f"WITH {RUNS} "
    + " UNION ALL ".join(
        f"SELECT symbol, date, '{k}' AS kind, prev_{c} AS from_state, {c} AS to_state FROM pv WHERE prev_{c} IS NOT NULL AND prev_{c} <> {c}"
        for k, c in (("phase", "phase"), ("volatility", "volatility_regime"), ("trend", "trend_direction"))
    ),
)
def state_transitions(spark, folder):
    df = ms.states(smooth_bars(spark, folder))
    return ms.transitions(df, {"phase": "phase", "volatility": "volatility_regime", "trend": "trend_direction"})


@query(
    "trading_signals",
    f"""WITH {BARS}, m AS (SELECT *, greatest(coalesce(close - {lag('close')}, 0), 0) AS gain, greatest(coalesce({lag('close')} - close, 0), 0) AS loss FROM bars),
    k AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS sma, {_RSI} AS rsi FROM m)
    SELECT symbol, date, coalesce(close > sma AND rsi > 30 AND rsi < 70, false) AS entry, coalesce(close < sma AND rsi > 70, false) AS exit,
      {s('CASE WHEN close > sma AND rsi > 30 AND rsi < 70 THEN close * 0.95::DOUBLE END')} AS stop_price FROM k""",
)
def trading_signals(spark, folder):
    out = ms.trading_signals(daily_bars(spark, folder))
    return out.select("symbol", "date", "entry", "exit", snap(F.col("stop_price")).alias("stop_price"))


_G, _L = roll("avg", "gain", 14), roll("avg", "loss", 14)
_P20 = roll("stddev_pop", "close", 20)


@query(
    "technical_suite",
    f"""WITH {BARS}, m AS (SELECT *, greatest(close - {lag('close')}, 0) AS g0, greatest({lag('close')} - close, 0) AS l0, row_number() OVER ({WS}) AS rn, {ewm('close', 12)} - {ewm('close', 26)} AS macd FROM bars),
    n AS (SELECT *, CASE WHEN rn > 1 THEN g0 END AS gain, CASE WHEN rn > 1 THEN l0 END AS loss, {ewm('macd', 9)} AS sig FROM m),
    k AS (SELECT symbol, date, CASE WHEN {_L} = 0 THEN 100 ELSE 100 - 100 / (1 + {div(_G, _L)}) END AS rsi, coalesce(macd > sig AND {lag('macd')} <= {lag('sig')}, false) AS cross_up,
      CASE WHEN close > {_M20} + 2 * {_P20} THEN 'above_upper' WHEN close < {_M20} - 2 * {_P20} THEN 'below_lower' WHEN {_M20} IS NOT NULL THEN 'within_bands' END AS position, {div(f'4 * {_P20}', _M20)} * 100 AS bandwidth FROM n)
    SELECT symbol, date, {s('rsi', 4)} AS rsi, cross_up AS bullish_crossover, position, {s('bandwidth', 4)} AS bandwidth,
      CAST(coalesce((rsi > 70 OR rsi < 30)::INT, 0) + cross_up::INT + coalesce((position <> 'within_bands')::INT, 0) AS INT) AS signal_count FROM k""",
)
def technical_suite(spark, folder):
    out = ms.technical_suite(daily_bars(spark, folder))
    return out.select("symbol", "date", snap(F.col("rsi"), 4).alias("rsi"), "bullish_crossover", "position", snap(F.col("bandwidth"), 4).alias("bandwidth"), "signal_count")


# --- regimes ----------------------------------------------------------------------------

REG = f"""{SMOOTH}, rg AS (SELECT symbol, date, coalesce(ret, 0) AS return_1d, coalesce({_chg(5)}, 0) AS return_5d, coalesce({_chg(20)}, 0) AS return_20d, coalesce({_chg(252)}, 0) AS momentum_12m,
  coalesce({roll('stddev_samp', 'ret', 20)} * sqrt(252), 0) AS volatility_20d, coalesce({roll('stddev_samp', 'ret', 60)} * sqrt(252), 0) AS volatility_60d, coalesce({_RSI}, 0) AS rsi, md AS macd,
  coalesce({div('volume', _V20)}, 0) AS volume_ratio, coalesce({roll('stddev_samp', 'ret', 20)} * sqrt(252), 0) * 100 AS vix, (close - max(close) OVER ({WS})) / max(close) OVER ({WS}) AS drawdown FROM mv)"""
_RULE = """CASE WHEN return_5d <= -0.1 AND volatility_20d >= 0.3 AND vix >= 35 AND drawdown >= -0.2 THEN 'crisis' WHEN volatility_20d >= 0.25 AND vix >= 25 THEN 'high_vol'
  WHEN return_20d >= 0.02 AND volatility_20d <= 0.15 AND rsi >= 50 AND drawdown <= -0.05 THEN 'bull_market' WHEN return_20d <= -0.02 AND volatility_20d >= 0.15 AND rsi <= 50 AND drawdown >= -0.15 THEN 'bear_market' ELSE 'sideways' END"""


@query(
    "regime_features",
    f"WITH {REG} SELECT symbol, date, "
    + ", ".join(f"{s(c, _PLACES.get(c, 5))} AS {c}" for c in rg.FEATURES if c != "yield_spread")
    + " FROM rg",
)
def regime_features(spark, folder):
    out = rg.regime_features(smooth_bars(spark, folder))
    return out.select("symbol", "date", *[snap(F.col(c), _PLACES.get(c, 5)).alias(c) for c in rg.FEATURES if c != "yield_spread"])


_LIKE = f"""{REG}, lk AS (SELECT *, {_RULE} AS rule_regime, (CASE WHEN return_20d > 0.01 THEN 2 ELSE 1 END) * (CASE WHEN volatility_20d < 0.15 THEN 1.5 ELSE 1 END) * (CASE WHEN rsi > 50 THEN 1.3 ELSE 1 END)::DOUBLE AS bull,
  (CASE WHEN return_20d < -0.01 THEN 2 ELSE 1 END) * (CASE WHEN volatility_20d > 0.15 THEN 1.5 ELSE 1 END) * (CASE WHEN rsi < 50 THEN 1.3 ELSE 1 END)::DOUBLE AS bear,
  (CASE WHEN volatility_20d > 0.25 THEN 3 ELSE 1 END) * (CASE WHEN vix > 25 THEN 2 ELSE 1 END)::DOUBLE AS high,
  (CASE WHEN return_5d < -0.05 THEN 2.5 ELSE 1 END) * (CASE WHEN volatility_20d > 0.3 THEN 2 ELSE 1 END) * (CASE WHEN drawdown < -0.15 THEN 2 ELSE 1 END)::DOUBLE AS crisis FROM rg),
pb AS (SELECT *, bull + bear + high + crisis + 3 AS total, greatest(bull, bear, high, crisis, 1) AS top FROM lk),
pk AS (SELECT *, CASE WHEN bull = top THEN 'bull_market' WHEN bear = top THEN 'bear_market' WHEN top = 1 THEN 'sideways' WHEN high = top THEN 'high_vol' ELSE 'crisis' END AS likely_regime, top / total AS likely_probability,
  CASE rule_regime WHEN 'crisis' THEN 0.9 WHEN 'sideways' THEN 0.6 ELSE 0.8 END AS rc FROM pb)"""


@query("regime_rules", f"WITH {REG} SELECT symbol, date, {_RULE} AS regime FROM rg")
def regime_rules(spark, folder):
    return rg.regime_features(smooth_bars(spark, folder)).select("symbol", "date", rg.by_rules().alias("regime"))


@query(
    "regime_likelihood",
    f"WITH {_LIKE} SELECT symbol, date, likely_regime, {s('likely_probability')} AS likely_probability, {s('crisis / total')} AS p_crisis FROM pk",
)
def regime_likelihood(spark, folder):
    out = rg.by_likelihood(rg.regime_features(smooth_bars(spark, folder)))
    return out.select("symbol", "date", "likely_regime", snap(F.col("likely_probability")).alias("likely_probability"), snap(F.col("p_crisis")).alias("p_crisis"))


@query(
    "regime_vote",
    f"""WITH {_LIKE}, vt AS (SELECT *, 0.4 * rc + CASE WHEN likely_regime = rule_regime THEN 0.3 * likely_probability ELSE 0 END AS v1, 0.3 * likely_probability + CASE WHEN likely_regime = rule_regime THEN 0.4 * rc ELSE 0 END AS v2 FROM pk)
    SELECT symbol, date, CASE WHEN v1 >= v2 THEN rule_regime ELSE likely_regime END AS regime, {s('greatest(v1, v2) / 0.7')} AS confidence FROM vt""",
)
def regime_vote(spark, folder):
    out = rg.by_vote(rg.by_likelihood(rg.regime_features(smooth_bars(spark, folder))))
    return out.select("symbol", "date", "regime", snap(F.col("confidence")).alias("confidence"))


@query("regime_mixture")
def regime_mixture(spark, folder):
    df = rg.by_mixture(rg.regime_features(smooth_bars(spark, folder)))
    return rg.by_vote(rg.by_likelihood(df), mixture=True).select("symbol", "date", "mixture_state", "mixture_regime", "regime")


@query(
    "regime_history",
    f"""WITH {REG}, r AS (SELECT symbol, date, {_RULE} AS regime FROM rg), p AS (SELECT *, lag(regime) OVER ({WS}) AS before, row_number() OVER ({WS}) AS n FROM r)
    SELECT symbol, date, regime, CAST(n - max(CASE WHEN regime = before THEN NULL ELSE n END) OVER ({WS}) + 1 AS INT) AS duration FROM p""",
)
def regime_history(spark, folder):
    df = rg.regime_features(smooth_bars(spark, folder)).select("symbol", "date", rg.by_rules().alias("regime"))
    return ms.run_length(df, "regime", "duration")


@query(
    "regime_transition_matrix",
    f"""WITH {REG}, r AS (SELECT symbol, date, {_RULE} AS regime FROM rg), p AS (SELECT *, lag(regime) OVER ({WS}) AS before FROM r), c AS (SELECT before AS from_state, regime AS to_state, count(*) AS moves FROM p WHERE before <> regime GROUP BY 1, 2)
    SELECT from_state, to_state, moves, {s('moves::DOUBLE / sum(moves) OVER (PARTITION BY from_state)')} AS probability FROM c""",
)
def regime_transition_matrix(spark, folder):
    df = rg.regime_features(smooth_bars(spark, folder)).select("symbol", "date", rg.by_rules().alias("regime"))
    return ms.transition_matrix(df, "regime").withColumn("probability", snap(F.col("probability")))


@query(
    "regime_triggers",
    f"""WITH {REG} SELECT symbol, date, array_to_string(list_filter([{', '.join(f"CASE WHEN abs({c} - coalesce(lag({c}) OVER ({WS}), 0)) > 0.1 THEN '{c}' END" for c in ('return_1d', 'return_5d', 'return_20d', 'volatility_20d', 'drawdown'))}], lambda x: x IS NOT NULL), ',') AS triggers FROM rg""",
)
def regime_triggers(spark, folder):
    df = rg.regime_features(smooth_bars(spark, folder))
    out = ms.moved_features(df, ["return_1d", "return_5d", "return_20d", "volatility_20d", "drawdown"])
    return out.select("symbol", "date", F.array_join("triggers", ",").alias("triggers"))


# --- weights ----------------------------------------------------------------------------


def factor_returns(spark, folder):
    """Per symbol, factor and day: tenth of the sign of the factor times a bounded return."""
    wide = fc.forward_return(fc.builtin_factors(daily_bars(spark, folder)))
    panel = fc.factor_panel(wide).where(F.col("value").isNotNull() & F.col("fwd_ret").isNotNull())
    ret = F.signum(F.col("value") - F.lit(0.1)) * F.least(F.col("fwd_ret"), F.lit(1.0)) * 0.1
    return panel.select(F.col("symbol").alias("portfolio_id"), "factor_id", "date", ret.alias("ret"))


RETS = (
    FACTORS
    + ", fr AS ("
    + " UNION ALL ".join(
        f"SELECT symbol AS portfolio_id, '{n}' AS factor_id, date, sign({n} - 0.1::DOUBLE) * least(fwd_ret, 1.0) * 0.1::DOUBLE AS ret FROM fac WHERE {n} IS NOT NULL AND fwd_ret IS NOT NULL"
        for n in NAMES
    )
    + ")"
)
_FW = "PARTITION BY portfolio_id, factor_id ORDER BY date"


@query(
    "weights_inverse_volatility",
    f"WITH {RETS}, v AS (SELECT portfolio_id, factor_id, 1 / stddev_samp(ret) AS i FROM fr GROUP BY 1, 2) SELECT portfolio_id, factor_id, {s('i / sum(i) OVER (PARTITION BY portfolio_id)')} AS weight FROM v",
)
def weights_inverse_volatility(spark, folder):
    return wt.inverse_volatility(factor_returns(spark, folder)).withColumn("weight", snap(F.col("weight")))


@query("weights_equal", f"WITH {RETS} SELECT portfolio_id, factor_id, 0.2::DOUBLE AS weight FROM fr GROUP BY 1, 2")
def weights_equal(spark, folder):
    return wt.equal_weights(factor_returns(spark, folder))


@query(
    "weights_thompson_mean",
    f"""WITH {RETS}, c AS (SELECT *, 1 + sum((ret > 0)::INT) OVER ({_FW}) AS a, 1 + sum((ret <= 0)::INT) OVER ({_FW}) AS b FROM fr), m AS (SELECT *, a::DOUBLE / (a + b) AS m FROM c)
    SELECT portfolio_id, factor_id, date, {s('m / sum(m) OVER (PARTITION BY portfolio_id, date)')} AS weight FROM m""",
)
def weights_thompson_mean(spark, folder):
    out = wt.thompson_mean_weights(factor_returns(spark, folder))
    return out.select("portfolio_id", "factor_id", "date", snap(F.col("weight")).alias("weight"))


@query("weights_thompson_draw")
def weights_thompson_draw(spark, folder):
    return wt.thompson_draw_weights(factor_returns(spark, folder), seed=11).select("portfolio_id", "factor_id", "date", "weight")


@query(
    "weights_ucb",
    f"""WITH {RETS}, u AS (SELECT *, avg(ret) OVER ({_FW}) + sqrt(2 * ln(dense_rank() OVER (PARTITION BY portfolio_id ORDER BY date)) / count(ret) OVER ({_FW})) AS u FROM fr),
    e AS (SELECT *, exp((u - max(u) OVER (PARTITION BY portfolio_id, date)) / 0.1) AS e FROM u)
    SELECT portfolio_id, factor_id, date, {s('e / sum(e) OVER (PARTITION BY portfolio_id, date)', 5)} AS weight FROM e""",
)
def weights_ucb(spark, folder):
    out = wt.ucb_weights(factor_returns(spark, folder))
    return out.select("portfolio_id", "factor_id", "date", snap(F.col("weight"), 5).alias("weight"))


_F = sorted(NAMES)
_WIDE = f"""{RETS}, wd AS (SELECT portfolio_id, date, {', '.join(f"coalesce(max(ret) FILTER (factor_id = '{n}'), 0.0) AS r{i}" for i, n in enumerate(_F))} FROM fr GROUP BY 1, 2),
    ws AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS t FROM wd)"""


def _recursive(new: str) -> str:
    """Walk the days; ``new`` is the un-normalised weight of factor {i}."""
    ws = ", ".join(f"({new.format(i=i)}) / nullif({' + '.join('(' + new.format(i=j) + ')' for j in range(5))}, 0) AS w{i}" for i in range(5))
    return f"""WITH RECURSIVE {_WIDE}, go AS (SELECT portfolio_id, 0::BIGINT AS t, NULL::DATE AS date, {', '.join(f'0.2::DOUBLE AS w{i}' for i in range(5))} FROM ws WHERE t = 1
      UNION ALL SELECT n.portfolio_id, n.t, n.date, {ws} FROM (SELECT s.*, g.w0, g.w1, g.w2, g.w3, g.w4, {' + '.join(f'w{i} * r{i}' for i in range(5))} AS p, {' + '.join(f'r{i}' for i in range(5))} AS whole FROM go g JOIN ws s ON s.portfolio_id = g.portfolio_id AND s.t = g.t + 1) n)
    {' UNION ALL '.join(f"SELECT portfolio_id, '{n}' AS factor_id, date, {s(f'w{i}')} AS weight FROM go WHERE t > 0" for i, n in enumerate(_F))}"""


@query("weights_gradient", _recursive("greatest(least(w{i} + 0.01::DOUBLE / sqrt(n.t) * (r{i} - p), 1), 0)"))
def weights_gradient(spark, folder):
    out = wt.learn(factor_returns(spark, folder), wt.gradient_step())
    return out.select("portfolio_id", "factor_id", "date", snap(F.col("weight")).alias("weight"))


def _momentum() -> str:
    speed = [f"0.9::DOUBLE * g.v{i} + 0.01::DOUBLE * s.r{i}" for i in range(5)]
    whole = " + ".join(f"abs(w{i} + x{i})" for i in range(5))
    step = ", ".join(f"(w{i} + x{i}) / CASE WHEN whole > 0 THEN whole ELSE 1 END" for i in range(5))
    return f"""WITH RECURSIVE {_WIDE}, go AS (SELECT portfolio_id, 0::BIGINT AS t, NULL::DATE AS date, {', '.join(f'0.2::DOUBLE AS w{i}' for i in range(5))}, {', '.join(f'0.0::DOUBLE AS v{i}' for i in range(5))} FROM ws WHERE t = 1
      UNION ALL SELECT portfolio_id, t, date, {step}, {', '.join(f'x{i}' for i in range(5))} FROM (SELECT *, {whole} AS whole FROM (
        SELECT s.portfolio_id, s.t, s.date, {', '.join(f'g.w{i}' for i in range(5))}, {', '.join(f'{v} AS x{i}' for i, v in enumerate(speed))} FROM go g JOIN ws s ON s.portfolio_id = g.portfolio_id AND s.t = g.t + 1)))
    {' UNION ALL '.join(f"SELECT portfolio_id, '{n}' AS factor_id, date, {s(f'w{i}')} AS weight FROM go WHERE t > 0" for i, n in enumerate(_F))}"""


@query("weights_momentum", _momentum())
def weights_momentum(spark, folder):
    out = wt.learn(factor_returns(spark, folder), wt.momentum_step())
    return out.select("portfolio_id", "factor_id", "date", snap(F.col("weight")).alias("weight"))


@query("weights_ewma", _recursive("CASE WHEN whole <> 0 THEN 0.99::DOUBLE * w{i} + 0.01::DOUBLE * abs(r{i} / whole) ELSE w{i} END"))
def weights_ewma(spark, folder):
    out = wt.learn(factor_returns(spark, folder), wt.ewma_step())
    return out.select("portfolio_id", "factor_id", "date", snap(F.col("weight")).alias("weight"))


@query("weights_rls")
def weights_rls(spark, folder):
    return wt.learn(factor_returns(spark, folder), wt.rls_step())


@query("weights_bandit")
def weights_bandit(spark, folder):
    return wt.learn(factor_returns(spark, folder), wt.bandit_step(seed=5))


@query("weights_ucb_feedback")
def weights_ucb_feedback(spark, folder):
    return wt.learn(factor_returns(spark, folder), wt.ucb_feedback_step())


@query("weights_regression")
def weights_regression(spark, folder):
    wide = fc.forward_return(fc.builtin_factors(daily_bars(spark, folder)))
    return wt.regression_weights(wide, fc.BUILT_IN, "fwd_ret")


_EQ = f"""{RETS}, dy AS (SELECT portfolio_id, date, avg(ret) AS r FROM fr GROUP BY 1, 2)"""
_PW = "PARTITION BY portfolio_id ORDER BY date"


@query(
    "learning_metrics",
    f"""WITH {_EQ}, gr AS (SELECT *, product(1 + r) OVER ({_PW}) AS g, count(r) OVER ({_PW}) AS n FROM dy), dd AS (SELECT *, (g - max(g) OVER ({_PW})) / nullif(max(g) OVER ({_PW}), 0) AS d FROM gr)
    SELECT portfolio_id, date, {s(f'CASE WHEN n > 1 AND stddev_pop(r) OVER ({_PW}) > 1e-12 THEN avg(r) OVER ({_PW}) / stddev_pop(r) OVER ({_PW}) ELSE 0 END', 4)} AS sharpe, {s(f'min(d) OVER ({_PW})', 5)} AS max_drawdown, {s(f'avg((r > 0)::INT) OVER ({_PW})')} AS hit_rate FROM dd""",
)
def learning_metrics(spark, folder):
    """A portfolio's return of a day is the mean of its factors' returns."""
    daily = factor_returns(spark, folder).groupBy("portfolio_id", "date").agg(F.avg("ret").alias("portfolio_ret"))
    out = wt.learning_metrics(daily)
    return out.select("portfolio_id", "date", snap(F.col("sharpe"), 4).alias("sharpe"), snap(F.col("max_drawdown"), 5).alias("max_drawdown"), snap(F.col("hit_rate")).alias("hit_rate"))


_TM = f"""{RETS}, c AS (SELECT *, 1 + sum((ret > 0)::INT) OVER ({_FW}) AS a, 1 + sum((ret <= 0)::INT) OVER ({_FW}) AS b FROM fr), m AS (SELECT *, a::DOUBLE / (a + b) AS m FROM c),
    w AS (SELECT portfolio_id, factor_id, date, ret, m / sum(m) OVER (PARTITION BY portfolio_id, date) AS weight FROM m)"""


@query(
    "learning_convergence",
    f"""WITH {_TM}, v AS (SELECT *, var_pop(weight) OVER ({_FW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v, count(*) OVER ({_FW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM w)
    SELECT portfolio_id, date, {s('CASE WHEN min(n) >= 10 THEN 1 / (1 + avg(v) * 10) ELSE 0 END')} AS convergence FROM v GROUP BY 1, 2""",
)
def learning_convergence(spark, folder):
    weights = wt.thompson_mean_weights(factor_returns(spark, folder))
    return wt.convergence(weights).withColumn("convergence", snap(F.col("convergence")))


@query("learning_rate_schedule")
def learning_rate_schedule(spark, folder):
    weights = wt.thompson_mean_weights(factor_returns(spark, folder))
    return wt.learning_rates(wt.convergence(weights))


@query(
    "factor_importance",
    f"WITH {_TM} SELECT portfolio_id, factor_id, {s('avg(ret * weight)')} AS importance FROM w GROUP BY 1, 2",
)
def factor_importance(spark, folder):
    rets = cut_lineage(factor_returns(spark, folder))
    return wt.importance(rets, wt.thompson_mean_weights(rets)).withColumn("importance", snap(F.col("importance")))


@query(
    "weights_turnover",
    f"""WITH {_TM}, l AS (SELECT *, lag(weight) OVER ({_FW}) AS o, first_value(date) OVER ({_PW}) AS f FROM w)
    SELECT portfolio_id, date, {s('sum(abs(weight - coalesce(o, 0))) / 2')} AS turnover, {s('sum(abs(weight - coalesce(o, 0))) / 2 * 0.001', 8)} AS cost FROM l GROUP BY 1, 2""",
)
def weights_turnover(spark, folder):
    """Each day's weights against those of the day before."""
    w = Window.partitionBy("portfolio_id", "factor_id").orderBy("date")
    new = cut_lineage(
        wt.thompson_mean_weights(factor_returns(spark, folder)).select("portfolio_id", "factor_id", "date", "weight")
    )
    old = new.withColumn("date", F.lead("date").over(w)).where(F.col("date").isNotNull())
    out = pf.weight_turnover(old, new, keys=("portfolio_id", "date"))
    return out.select("portfolio_id", "date", snap(F.col("turnover")).alias("turnover"), snap(F.col("cost"), 8).alias("cost"))


@query(
    "weights_rebalance_days",
    f"""WITH RECURSIVE {RETS}, d AS (SELECT DISTINCT portfolio_id, date FROM fr), go AS (SELECT portfolio_id, min(date) AS date FROM d GROUP BY 1
      UNION ALL SELECT portfolio_id, date FROM (SELECT d.portfolio_id, min(d.date) AS date FROM go g JOIN d ON d.portfolio_id = g.portfolio_id AND d.date >= g.date + 30 GROUP BY 1)) SELECT portfolio_id, date FROM go""",
)
def weights_rebalance_days(spark, folder):
    return wt.rebalance_days(factor_returns(spark, folder), 30)


@query(
    "weights_active_factors",
    f"""WITH {RETS}, a AS (SELECT factor_id FROM fr GROUP BY 1 HAVING avg(ret) > 0) SELECT factor_id, count(*) AS rows FROM fr WHERE factor_id IN (SELECT factor_id FROM a) GROUP BY 1""",
)
def weights_active_factors(spark, folder):
    rets = cut_lineage(factor_returns(spark, folder))
    catalogue = rets.groupBy("factor_id").agg(F.when(F.avg("ret") > 0, "active").otherwise("testing").alias("status"))
    return wt.active_only(rets, catalogue).groupBy("factor_id").agg(F.count(F.lit(1)).alias("rows"))


@query("weights_active_learning")
def weights_active_learning(spark, folder):
    """Weights learnt on factors whose mean return is above zero."""
    rets = cut_lineage(factor_returns(spark, folder))
    catalogue = rets.groupBy("factor_id").agg(F.when(F.avg("ret") > 0, "active").otherwise("testing").alias("status"))
    return wt.learn_active(rets, catalogue, wt.ewma_step(), F.lit("2026-01-01").cast("date"))


@query(
    "weights_rebalance_statistics",
    f"""WITH RECURSIVE {RETS}, d AS (SELECT DISTINCT portfolio_id, date FROM fr), go AS (SELECT portfolio_id, min(date) AS date FROM d GROUP BY 1
      UNION ALL SELECT portfolio_id, date FROM (SELECT d.portfolio_id, min(d.date) AS date FROM go g JOIN d ON d.portfolio_id = g.portfolio_id AND d.date >= g.date + 30 GROUP BY 1)),
    w AS (SELECT portfolio_id, date, factor_id, (1 + abs(ret)) / sum(1 + abs(ret)) OVER (PARTITION BY portfolio_id, date) AS weight FROM fr SEMI JOIN go USING (portfolio_id, date)),
    k AS (SELECT portfolio_id, date, lead(date) OVER (PARTITION BY portfolio_id ORDER BY date) AS after FROM go),
    o AS (SELECT w.portfolio_id, k.after AS date, factor_id, weight FROM w JOIN k USING (portfolio_id, date) WHERE k.after IS NOT NULL),
    n AS (SELECT w.* FROM w JOIN (SELECT DISTINCT portfolio_id, after AS date FROM k WHERE after IS NOT NULL) USING (portfolio_id, date)),
    m AS (SELECT portfolio_id, date, sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) / 2 AS turnover FROM o FULL JOIN n USING (portfolio_id, date, factor_id) GROUP BY 1, 2)
    SELECT count(*) AS rebalances, {s('avg(turnover)')} AS avg_turnover, {s('sum(turnover * 0.001::DOUBLE)', 4)} AS total_cost FROM m""",
)
def weights_rebalance_statistics(spark, folder):
    """Weights by size of return on the rebalance days; each day against the one before."""
    c = F.col
    rets = cut_lineage(factor_returns(spark, folder))
    days = wt.rebalance_days(rets, 30)
    day = Window.partitionBy("portfolio_id", "date")
    held = rets.join(days, ["portfolio_id", "date"], "left_semi").withColumn(
        "weight", (1 + F.abs("ret")) / F.sum(1 + F.abs("ret")).over(day)
    )
    after = days.withColumn("after", F.lead("date").over(Window.partitionBy("portfolio_id").orderBy("date"))).where(c("after").isNotNull())
    old = held.join(after, ["portfolio_id", "date"]).select("portfolio_id", c("after").alias("date"), "factor_id", "weight")
    new = held.join(after.select("portfolio_id", c("after").alias("date")), ["portfolio_id", "date"], "left_semi")
    moved = pf.weight_turnover(old, new, keys=["portfolio_id", "date"])
    out = wt.rebalance_statistics(moved)
    return out.select("rebalances", snap(c("avg_turnover")).alias("avg_turnover"), snap(c("total_cost"), 4).alias("total_cost"))
