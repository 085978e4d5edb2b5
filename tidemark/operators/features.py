"""Price, volume, technical, cross-sectional and interaction features.

A feature is a short list of levels; a level holds columns that may read the columns
of the level before. All features asked for in one call share one partitioning and
one sort, so any number of them costs a single shuffle of the bars.

Bars are unique on (symbol, date): the longest partition is the calendar, not the
trade volume of a hot symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.columns import (
    average_rank,
    change,
    clean,
    ewm_means,
    ordered,
    pad,
    ratio,
    roll_mean,
    roll_std,
    roll_sum,
    guarded,
)

Build = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Level:
    columns: dict[str, Build] = field(default_factory=dict)
    means: dict[str, tuple[str, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    needs: tuple[str, ...]
    levels: tuple[Level, ...]


def rsi_from(gain: Column, loss: Column) -> Column:
    """100 for a rise without a fall; null when nothing moved."""
    return (
        F.when((loss == 0) & (gain > 0), 100.0)
        .when(loss == 0, None)
        .otherwise(100 - 100 / (1 + ratio(gain, loss)))
    )


def _c(name: str) -> Column:
    return F.col(name)


def _one(name: str, family: str, needs: Sequence[str], build: Build) -> Feature:
    return Feature(name, family, tuple(needs), (Level({name: build}),))


def price_features(periods: int = 1) -> list[Feature]:
    back = lambda w: F.lag("close", periods).over(w)
    return [
        _one("returns", "price", ["close"], lambda w: change(_c("close"), w, periods)),
        _one("log_returns", "price", ["close"], lambda w: F.ln(ratio(_c("close"), back(w)))),
        _one("price_change", "price", ["close"], lambda w: _c("close") - back(w)),
        _one("price_ratio", "price", ["close"], lambda w: ratio(_c("close"), back(w))),
        _one("high_low_ratio", "price", ["high", "low"], lambda w: ratio(_c("high"), _c("low"))),
        _one("close_to_high", "price", ["close", "high"], lambda w: ratio(_c("close"), _c("high"))),
        _one("close_to_low", "price", ["close", "low"], lambda w: ratio(_c("close"), _c("low"))),
    ]


def volume_features(window: int = 20, periods: int = 1) -> list[Feature]:
    return [
        _one("volume_change", "volume", ["volume"], lambda w: change(_c("volume"), w, periods)),
        _one("volume_ratio", "volume", ["volume"], lambda w: ratio(_c("volume"), F.lag("volume", periods).over(w))),
        _one("volume_ma", "volume", ["volume"], lambda w: roll_mean(_c("volume"), w, window)),
        _one("volume_std", "volume", ["volume"], lambda w: roll_std(_c("volume"), w, window)),
        _one(
            "vwap",
            "volume",
            ["close", "volume"],
            lambda w: ratio(roll_sum(_c("close") * _c("volume"), w, window), roll_sum(_c("volume"), w, window)),
        ),
        Feature(
            "volume_price_trend",
            "volume",
            ("close", "volume"),
            (
                Level({"__signed": lambda w: F.signum(_c("close") - F.lag("close").over(w)) * _c("volume")}),
                Level({"volume_price_trend": lambda w: roll_sum(_c("__signed"), w, window)}),
            ),
        ),
    ]


_MOVES = Level(
    {
        "__gain": lambda w: F.greatest(F.coalesce(_c("close") - F.lag("close").over(w), F.lit(0.0)), F.lit(0.0)),
        "__loss": lambda w: F.greatest(F.coalesce(F.lag("close").over(w) - _c("close"), F.lit(0.0)), F.lit(0.0)),
    }
)


def rsi_feature(window: int = 14, name: str = "rsi") -> Feature:
    return Feature(
        name,
        "technical",
        ("close",),
        (
            _MOVES,
            Level(
                {
                    name: lambda w: rsi_from(
                        roll_mean(_c("__gain"), w, window), roll_mean(_c("__loss"), w, window)
                    )
                }
            ),
        ),
    )


def macd_features(fast: int = 12, slow: int = 26, signal: int = 9) -> list[Feature]:
    emas = Level(means={"__fast": ("close", fast), "__slow": ("close", slow)})
    line = Level({"__macd": lambda w: _c("__fast") - _c("__slow")})
    sig = Level(means={"__signal": ("__macd", signal)})
    return [
        Feature("macd", "technical", ("close",), (emas, Level({"macd": lambda w: _c("__fast") - _c("__slow")}))),
        Feature("macd_signal", "technical", ("close",), (emas, line, sig, Level({"macd_signal": lambda w: _c("__signal")}))),
        Feature(
            "macd_histogram",
            "technical",
            ("close",),
            (emas, line, sig, Level({"macd_histogram": lambda w: _c("__macd") - _c("__signal")})),
        ),
    ]


def technical_features(window: int = 20, num_std: float = 2.0) -> list[Feature]:
    band = lambda w: roll_std(_c("close"), w, window) * num_std
    k = lambda w: 100 * ratio(
        _c("close") - guarded(F.min("low"), _c("low"), w, 14),
        guarded(F.max("high"), _c("high"), w, 14) - guarded(F.min("low"), _c("low"), w, 14),
    )
    true_range = lambda w: F.greatest(
        _c("high") - _c("low"),
        F.abs(_c("high") - F.lag("close").over(w)),
        F.abs(_c("low") - F.lag("close").over(w)),
    )
    return [
        _one("sma", "technical", ["close"], lambda w: roll_mean(_c("close"), w, window)),
        Feature("ema", "technical", ("close",), (Level(means={"ema": ("close", window)}),)),
        rsi_feature(14),
        *macd_features(),
        _one("bollinger_middle", "technical", ["close"], lambda w: roll_mean(_c("close"), w, window)),
        _one("bollinger_upper", "technical", ["close"], lambda w: roll_mean(_c("close"), w, window) + band(w)),
        _one("bollinger_lower", "technical", ["close"], lambda w: roll_mean(_c("close"), w, window) - band(w)),
        _one("bollinger_bandwidth", "technical", ["close"], lambda w: ratio(2 * band(w), roll_mean(_c("close"), w, window))),
        _one("stochastic_k", "technical", ["high", "low", "close"], k),
        Feature(
            "stochastic_d",
            "technical",
            ("high", "low", "close"),
            (Level({"__k": k}), Level({"stochastic_d": lambda w: roll_mean(_c("__k"), w, 3, 1)})),
        ),
        Feature(
            "atr",
            "technical",
            ("high", "low", "close"),
            (Level({"__tr": true_range}), Level({"atr": lambda w: roll_mean(_c("__tr"), w, 14)})),
        ),
        _one("momentum", "technical", ["close"], lambda w: ratio(_c("close"), F.lag("close", 10).over(w)) - 1),
    ]


class FeatureBook:
    """Named features; users add their own column builders next to the defaults."""

    def __init__(self) -> None:
        self._features: dict[str, Feature] = {}
        for f in [*price_features(), *volume_features(), *technical_features()]:
            self.add(f)

    def add(self, feature: Feature) -> None:
        self._features[feature.name] = feature

    def register(self, name: str, build: Build, needs: Sequence[str], family: str = "custom") -> None:
        self.add(_one(name, family, needs, build))

    def remove(self, name: str) -> bool:
        return self._features.pop(name, None) is not None

    def names(self, family: str | None = None) -> list[str]:
        return [n for n, f in self._features.items() if family in (None, f.family)]

    def compute(
        self,
        bars: DataFrame,
        names: Iterable[str] | None = None,
        keys: Sequence[str] = ("symbol",),
        order: Sequence[str] = ("date",),
        last_rows: int | None = None,
    ) -> DataFrame:
        """Add the named features (default: all whose inputs the bars have)."""
        if names is None:
            chosen = [f for f in self._features.values() if set(f.needs) <= set(bars.columns)]
        else:
            chosen = [self._features[n] for n in names]
            lacking = {c for f in chosen for c in f.needs} - set(bars.columns)
            if lacking:
                raise ValueError(f"bars lack the columns {sorted(lacking)}")
        needs = sorted({c for f in chosen for c in f.needs})
        w = ordered(keys, order)
        df = bars.withColumns({c: clean(F.col(c)) for c in needs if c != "volume"})
        if last_rows is not None:
            newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
            df = df.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last_rows).drop("__n")
        for c in needs:
            df = pad(df, c, w) if c == "close" else df
        for depth in range(max((len(f.levels) for f in chosen), default=0)):
            here = [f.levels[depth] for f in chosen if depth < len(f.levels)]
            means = {k: v for lv in here for k, v in lv.means.items()}
            columns = {k: v for lv in here for k, v in lv.columns.items()}
            if means:
                df = ewm_means(df, w, means)
            if columns:
                df = df.withColumns({k: build(w) for k, build in columns.items()})
        return df.drop(*[c for c in df.columns if c.startswith("__")])


    def compute_isolated(self, bars: DataFrame, names: Iterable[str] | None = None, **how) -> tuple[DataFrame, dict[str, str]]:
        """The features that can be built, and why each of the others cannot.

        A feature is tried on the plan alone: unknown names, missing inputs, columns that do not
        resolve and errors of a user's builder are told; no job runs and the rest is computed.
        """
        good, failed = [], {}
        for name in dict.fromkeys(self._features if names is None else names):
            if name not in self._features:
                failed[name] = "not registered"
                continue
            try:
                self.compute(bars, [name], **how)
            except Exception as error:  # the builder is the user's code
                failed[name] = (str(error).splitlines() or [type(error).__name__])[0]
            else:
                good.append(name)
        return self.compute(bars, good, **how), failed


def grouped_feature(bars: DataFrame, name: str, fn, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Slow path for a user function ``frame -> series`` over one symbol's bars."""
    schema = bars.schema.simpleString()[len("struct<") : -1] + f",{name}:double"

    def per_symbol(frame):
        frame = frame.sort_values("date")
        frame[name] = fn(frame).astype(float)
        return frame

    return bars.groupBy(*keys).applyInPandas(per_symbol, schema)


# --- cross section -----------------------------------------------------------------


def cross_rank(df: DataFrame, x: str, out: str, pct: bool = False, ascending: bool = True, keys=("date",)) -> DataFrame:
    src = x
    if not ascending:
        df, src = df.withColumn("__neg", -F.col(x)), "__neg"
    rank = average_rank(src, keys)
    if pct:
        rank = ratio(rank, F.count(src).over(Window.partitionBy(*keys)))
    return df.withColumn(out, rank).drop("__neg")


def cross_zscore(df: DataFrame, x: str, out: str, keys=("date",)) -> DataFrame:
    xs = Window.partitionBy(*keys)
    return df.withColumn(out, ratio(F.col(x) - F.avg(x).over(xs), F.stddev_samp(x).over(xs)))


def industry_neutral(df: DataFrame, x: str, industry: str | None, out: str, keys=("date",)) -> DataFrame:
    """Z-score inside the industry; lone or flat groups keep the raw value."""
    if industry is None:
        return df.withColumn(out, F.col(x))
    xs = Window.partitionBy(*keys, industry)
    spread = F.stddev_samp(x).over(xs)
    return df.withColumn(
        out,
        F.when((F.count(F.lit(1)).over(xs) > 1) & (spread > 0), (F.col(x) - F.avg(x).over(xs)) / spread).otherwise(
            F.col(x)
        ),
    )


# --- interactions ------------------------------------------------------------------


def interact(a: str, b: str, how: str) -> Column:
    left, right = F.col(a), F.col(b)
    if how == "multiply":
        return left * right
    if how == "divide":
        return ratio(left, right)
    if how == "add":
        return left + right
    if how == "subtract":
        return left - right
    raise ValueError(f"unknown interaction {how}")
