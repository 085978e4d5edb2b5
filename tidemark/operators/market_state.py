"""Market indicators, phases, durations and transitions, per row of every symbol."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import change, clip, ewm_means, ordered, ratio, roll_mean, roll_std
from tidemark.operators.features import rsi_from

# Thresholds of the states.
VOLATILITY = {"low": 0.10, "normal": 0.20, "high": 0.30, "extreme": 0.50}
STRONG_TREND, WEAK_TREND = 0.05, 0.02
# Chances of the phase after each phase.
NEXT_PHASE = {
    "accumulation": {"markup": 0.4, "consolidation": 0.3, "distribution": 0.2, "accumulation": 0.1},
    "markup": {"distribution": 0.5, "markup": 0.3, "consolidation": 0.2},
    "distribution": {"markdown": 0.4, "consolidation": 0.3, "accumulation": 0.2, "distribution": 0.1},
    "markdown": {"accumulation": 0.5, "markdown": 0.3, "consolidation": 0.2},
    "consolidation": {"accumulation": 0.3, "distribution": 0.3, "consolidation": 0.2, "markup": 0.1, "markdown": 0.1},
}


def indicators(bars: DataFrame) -> DataFrame:
    """Indicators as of every row; a value not yet defined takes its default."""
    w = ordered(["symbol"], ["date"])
    c, v = F.col("close"), F.col("volume")
    df = ewm_means(bars, w, {"__e12": ("close", 12), "__e26": ("close", 26)})
    df = df.withColumns(
        {
            "__n": F.row_number().over(w),
            "__ret": change(c, w),
            "__gain": F.greatest(F.coalesce(c - F.lag("close").over(w), F.lit(0.0)), F.lit(0.0)),
            "__loss": F.greatest(F.coalesce(F.lag("close").over(w) - c, F.lit(0.0)), F.lit(0.0)),
        }
    )
    n = F.col("__n")
    mean, sd = roll_mean(c, w, 20), roll_std(c, w, 20)
    short, long = roll_mean(v, w, 5), roll_mean(v, w, 20)
    enough = lambda k, x, default: F.when(n > k, x).otherwise(default)
    df = df.withColumns(
        {
            "price_change_1d": enough(1, change(c, w), 0.0),
            "price_change_5d": enough(5, change(c, w, 5), 0.0),
            "price_change_20d": enough(20, change(c, w, 20), 0.0),
            "realized_volatility": enough(20, roll_std(F.col("__ret"), w, 20) * math.sqrt(252), 0.0),
            "momentum_short": enough(10, change(c, w, 10), 0.0),
            "momentum_medium": enough(50, change(c, w, 50), 0.0),
            "momentum_long": enough(200, change(c, w, 200), 0.0),
            "rsi": enough(14, rsi_from(roll_mean(F.col("__gain"), w, 14), roll_mean(F.col("__loss"), w, 14)), 50.0),
            "macd": enough(26, F.col("__e12") - F.col("__e26"), 0.0),
            "bollinger_position": enough(
                20, F.when(sd > 0, clip(ratio(c - (mean - 2 * sd), 4 * sd), 0, 1)).otherwise(0.5), 0.5
            ),
            "volume_ratio": enough(20, F.coalesce(ratio(v, long), F.lit(1.0)), 1.0),
            "volume_trend": enough(20, F.coalesce(ratio(short - long, long), F.lit(0.0)), 0.0),
        }
    )
    df = df.withColumn(
        "vix_level", F.when(F.col("realized_volatility") > 0, F.col("realized_volatility") * 100).otherwise(20.0)
    )
    return df.drop("__e12", "__e26", "__n", "__ret", "__gain", "__loss")


def _c(name: str) -> Column:
    return F.col(name)


def phase() -> Column:
    m, s = _c("momentum_medium"), _c("momentum_short")
    busy = _c("volume_ratio") > 1.2
    score = (
        F.when(m > 0.05, 2).when(m > 0.02, 1).when(m < -0.05, -2).when(m < -0.02, -1).otherwise(0)
        + F.when(_c("rsi") > 70, 1).when(_c("rsi") < 30, -1).otherwise(0)
        + F.when(busy & (s > 0), 1).when(busy & (s < 0), -1).otherwise(0)
    )
    wild = _c("realized_volatility") > 0.25
    return (
        F.when(wild & (score > 0), "markup")
        .when(wild, "markdown")
        .when(score >= 3, "markup")
        .when(score >= 1, "accumulation")
        .when(score <= -3, "markdown")
        .when(score <= -1, "distribution")
        .otherwise("consolidation")
    )


def volatility_regime() -> Column:
    v = _c("realized_volatility")
    return (
        F.when(v >= VOLATILITY["extreme"], "extreme")
        .when(v >= VOLATILITY["high"], "high")
        .when(v >= VOLATILITY["normal"], "normal")
        .otherwise("low")
    )


def trend_direction() -> Column:
    m = _c("momentum_medium")
    return (
        F.when(m >= STRONG_TREND, "strong_uptrend")
        .when(m >= WEAK_TREND, "uptrend")
        .when(m <= -STRONG_TREND, "strong_downtrend")
        .when(m <= -WEAK_TREND, "downtrend")
        .otherwise("sideways")
    )


def liquidity_condition() -> Column:
    r, v = _c("volume_ratio"), _c("realized_volatility")
    return (
        F.when((r > 1.5) & (v < 0.15), "abundant")
        .when(((r < 0.7) | (v > 0.30)) & (v > 0.40), "stressed")
        .when((r < 0.7) | (v > 0.30), "tight")
        .otherwise("normal")
    )


def confidences() -> dict[str, Column]:
    """Confidence per dimension from the indicator and state columns."""
    m, rsi, v, r = _c("momentum_medium"), _c("rsi"), _c("realized_volatility"), _c("volume_ratio")
    p, vol, trend = _c("phase"), _c("volatility_regime"), _c("trend_direction")
    rising, falling = p.isin("markup", "accumulation"), p.isin("markdown", "distribution")
    momentum = F.when((rising & (m > 0)) | (falling & (m < 0)), F.least(F.abs(m) * 10, F.lit(1.0)))
    strength = F.when((p == "markup") & (rsi > 50), (rsi - 50) / 50).when((p == "markdown") & (rsi < 50), (50 - rsi) / 50)
    votes = F.array_compact(F.array(momentum, strength))
    mean = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / F.size(votes)
    t = VOLATILITY
    middle = (t["low"] + t["normal"]) / 2
    return {
        "phase_confidence": F.when(F.size(votes) > 0, mean).otherwise(0.5),
        "volatility_confidence": F.when(vol == "low", F.greatest(F.lit(0.0), 1 - v / t["low"]))
        .when((vol == "normal") & (v < t["normal"]), 1 - F.abs(v - middle) / t["normal"])
        .when(vol == "normal", 0.5)
        .when((vol == "high") & v.between(t["normal"], t["high"]) & (v < t["high"]), (v - t["normal"]) / (t["high"] - t["normal"]))
        .when(vol == "high", 0.5)
        .otherwise(F.least(F.lit(1.0), v / t["extreme"])),
        "trend_confidence": F.when(trend.startswith("strong"), F.least(F.lit(1.0), F.abs(m) / STRONG_TREND))
        .when(trend != "sideways", F.least(F.lit(1.0), F.abs(m) / (STRONG_TREND / 2)))
        .otherwise(F.greatest(F.lit(0.0), 1 - F.abs(m) * 10)),
        "liquidity_confidence": F.when(
            _c("liquidity_condition") == "abundant", F.least(F.lit(1.0), r / 1.5) * F.greatest(F.lit(0.0), 1 - v / 0.15)
        )
        .when(_c("liquidity_condition") == "stressed", F.least(F.lit(1.0), v / 0.40))
        .otherwise(0.7),
    }


def overall_confidence() -> Column:
    """Mean of the confidences above zero."""
    held = F.filter(
        F.array("phase_confidence", "volatility_confidence", "trend_confidence", "liquidity_confidence"), lambda x: x > 0
    )
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)).otherwise(0.0)


def transition_signals() -> Column:
    v, r = _c("realized_volatility"), _c("volume_ratio")
    return F.array_compact(
        F.array(
            F.when(_c("rsi") > 80, "rsi_overbought").when(_c("rsi") < 20, "rsi_oversold"),
            F.when(v > 0.35, "volatility_surge").when(v < 0.08, "volatility_very_low"),
            F.when(r > 2.0, "volume_surge").when(r < 0.5, "volume_shrink"),
            F.when(_c("momentum_short") * _c("momentum_medium") < 0, "momentum_divergence"),
        )
    )


def next_phases() -> Column:
    table = F.create_map(
        *[
            x
            for p, chances in NEXT_PHASE.items()
            for x in (F.lit(p), F.create_map(*[F.lit(y) for kv in chances.items() for y in kv]))
        ]
    )
    return table[_c("phase")]


def run_length(df: DataFrame, state: str, out: str, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Rows since the state last changed, this one included."""
    w = Window.partitionBy(*keys).orderBy(order)
    began = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), None).otherwise(F.row_number().over(w))
    df = df.withColumns({"__b": began, "__n": F.row_number().over(w)})
    since = F.last("__b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.col("__n") - since + 1).drop("__b", "__n")


def states(bars: DataFrame) -> DataFrame:
    """The full state row: indicators, four states, confidences, run lengths, signals."""
    df = indicators(bars).withColumns(
        {
            "phase": phase(),
            "volatility_regime": volatility_regime(),
            "trend_direction": trend_direction(),
            "liquidity_condition": liquidity_condition(),
        }
    )
    df = df.withColumns(confidences())
    df = df.withColumns(
        {"overall_confidence": overall_confidence(), "signals": transition_signals(), "next_phases": next_phases()}
    )
    for state, out in (("phase", "phase_duration"), ("volatility_regime", "volatility_duration"), ("trend_direction", "trend_duration")):
        df = run_length(df, state, out)
    return df


def latest(df: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Newest row per key; each task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def transitions(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """One row per change of a state column; ``columns`` maps transition kind to column."""
    w = Window.partitionBy(*keys).orderBy(order)
    moved = F.array_compact(
        F.array(
            *[
                F.when(
                    F.lag(c).over(w).isNotNull() & (F.lag(c).over(w) != F.col(c)),
                    F.struct(F.lit(kind).alias("kind"), F.lag(c).over(w).alias("from_state"), F.col(c).alias("to_state")),
                )
                for kind, c in columns.items()
            ]
        )
    )
    return df.withColumn("__m", moved).select(*keys, order, F.explode("__m").alias("m")).select(*keys, order, "m.*")


def transition_matrix(df: DataFrame, state: str, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Share of each target among the changes out of a state."""
    moves = transitions(df, {"state": state}, keys, order)
    counts = moves.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("moves"))
    return counts.withColumn("probability", F.col("moves") / F.sum("moves").over(Window.partitionBy("from_state")))


def moved_features(df: DataFrame, features: Sequence[str], limit: float = 0.1, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Names of the features that moved by more than ``limit`` since the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = F.array_compact(
        F.array(*[F.when(F.abs(F.col(f) - F.coalesce(F.lag(f).over(w), F.lit(0.0))) > limit, F.lit(f)) for f in features])
    )
    return df.withColumn("triggers", names)


def trading_signals(bars: DataFrame) -> DataFrame:
    """Entry and exit flags: above the 20-row mean with a mid RSI, or below it while
    overbought; with the stop and target prices of an entry."""
    w = ordered(["symbol"], ["date"])
    c = F.col("close")
    df = bars.withColumns(
        {
            "__gain": F.greatest(F.coalesce(c - F.lag("close").over(w), F.lit(0.0)), F.lit(0.0)),
            "__loss": F.greatest(F.coalesce(F.lag("close").over(w) - c, F.lit(0.0)), F.lit(0.0)),
        }
    )
    df = df.withColumns(
        {
            "sma20": roll_mean(c, w, 20),
            "rsi14": rsi_from(roll_mean(F.col("__gain"), w, 14), roll_mean(F.col("__loss"), w, 14)),
        }
    )
    entry = (c > F.col("sma20")) & (F.col("rsi14") > 30) & (F.col("rsi14") < 70)
    return df.withColumns(
        {
            "entry": F.coalesce(entry, F.lit(False)),
            "exit": F.coalesce((c < F.col("sma20")) & (F.col("rsi14") > 70), F.lit(False)),
            "stop_price": F.when(entry, c * 0.95),
            "target_price": F.when(entry, c * 1.10),
        }
    ).drop("__gain", "__loss")


def technical_suite(bars: DataFrame) -> DataFrame:
    """RSI from the last 14 moves, MACD crossover, Bollinger place and width (population
    deviation), and the list of signals; as of every row."""
    w = ordered(["symbol"], ["date"])
    c = F.col("close")
    df = ewm_means(bars, w, {"__e12": ("close", 12), "__e26": ("close", 26)})
    df = df.withColumns(
        {
            "macd": F.col("__e12") - F.col("__e26"),
            "__gain": F.greatest(c - F.lag("close").over(w), F.lit(0.0)),
            "__loss": F.greatest(F.lag("close").over(w) - c, F.lit(0.0)),
            "__n": F.row_number().over(w),
        }
    )
    df = df.withColumn("__gain", F.when(F.col("__n") > 1, F.col("__gain"))).withColumn(
        "__loss", F.when(F.col("__n") > 1, F.col("__loss"))
    )
    df = ewm_means(df, w, {"signal": ("macd", 9)})
    gain, loss = roll_mean(F.col("__gain"), w, 14), roll_mean(F.col("__loss"), w, 14)
    mean = roll_mean(c, w, 20)
    sd = F.when(F.count("close").over(w.rowsBetween(-19, 0)) >= 20, F.stddev_pop("close").over(w.rowsBetween(-19, 0)))
    upper, lower = mean + 2 * sd, mean - 2 * sd
    crossed = (F.col("macd") > F.col("signal")) & (F.lag("macd").over(w) <= F.lag("signal").over(w))
    df = df.withColumns(
        {
            "rsi": F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss))),
            "bullish_crossover": F.coalesce(crossed, F.lit(False)),
            "position": F.when(c > upper, "above_upper").when(c < lower, "below_lower").when(mean.isNotNull(), "within_bands"),
            "bandwidth": ratio(upper - lower, mean) * 100,
        }
    )
    signals = F.array_compact(
        F.array(
            F.when(F.col("rsi") > 70, "rsi_overbought").when(F.col("rsi") < 30, "rsi_oversold"),
            F.when(F.col("bullish_crossover"), "macd_golden_cross"),
            F.when(F.col("position") == "above_upper", "above_upper_band").when(F.col("position") == "below_lower", "below_lower_band"),
        )
    )
    return df.withColumns({"signals": signals, "signal_count": F.size(signals)}).drop(
        "__e12", "__e26", "__gain", "__loss", "__n"
    )

