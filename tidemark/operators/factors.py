"""Built-in factors, the long factor panel, composite scores and rankings."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.columns import change, clean, ordered, pad, ratio, roll_mean, roll_std
from tidemark.operators.features import rsi_from

BUILT_IN = ("momentum_20d", "mean_reversion_10d", "volatility_20d", "volume_ratio_20d", "rsi_14d")
TRADING_DAYS = 252


def builtin_factors(bars: DataFrame) -> DataFrame:
    """The five built-in factors beside the bars; one shuffle, one sort."""
    w = ordered(["symbol"], ["date"])
    df = pad(bars, "close", w)
    close = F.col("close")
    df = df.withColumns(
        {
            "__ret": change(close, w),
            "__gain": F.greatest(F.coalesce(close - F.lag("close").over(w), F.lit(0.0)), F.lit(0.0)),
            "__loss": F.greatest(F.coalesce(F.lag("close").over(w) - close, F.lit(0.0)), F.lit(0.0)),
        }
    )
    rsi = rsi_from(roll_mean(F.col("__gain"), w, 14), roll_mean(F.col("__loss"), w, 14))
    df = df.withColumns(
        {
            "momentum_20d": change(close, w, 20),
            "mean_reversion_10d": ratio(close - roll_mean(close, w, 10), roll_mean(close, w, 10)),
            "volatility_20d": roll_std(F.col("__ret"), w, 20) * math.sqrt(TRADING_DAYS),
            "volume_ratio_20d": ratio(F.col("volume"), roll_mean(F.col("volume"), w, 20)),
            "rsi_14d": (rsi - 50) / 50,
        }
    )
    return df.drop("__ret", "__gain", "__loss")


def forward_return(df: DataFrame, out: str = "fwd_ret") -> DataFrame:
    w = ordered(["symbol"], ["date"])
    return df.withColumn(out, ratio(F.lead("close").over(w), F.col("close")) - 1)


@dataclass(frozen=True)
class Factor:
    """A factor: a column built from ``needs``, which are columns of the bars or other factors."""

    factor_id: str
    needs: tuple[str, ...]
    calculate: Callable[[WindowSpec], Column]
    category: str = "custom"
    status: str = "active"


class FactorRegistry:
    """Registered factors; only active ones, with active needs, are calculated."""

    def __init__(self) -> None:
        self._factors: dict[str, Factor] = {}

    def register(self, factor: Factor) -> None:
        if factor.factor_id in self._factors:
            raise ValueError(f"factor {factor.factor_id} is registered twice")
        if factor.factor_id in factor.needs:
            raise ValueError(f"factor {factor.factor_id} needs itself")
        self._factors[factor.factor_id] = factor

    def set_status(self, factor_id: str, status: str) -> None:
        self._factors[factor_id] = replace(self._factors[factor_id], status=status)

    def names(self, status: str | None = "active") -> list[str]:
        return [n for n, f in self._factors.items() if status in (None, f.status)]

    def levels(self, factor_ids: Sequence[str], columns: Sequence[str]) -> list[list[Factor]]:
        """Factors by depth, each after what it needs; an error for what is absent, not active or in a circle."""
        depth: dict[str, int] = {}

        def visit(name: str, path: tuple[str, ...]) -> int:
            if name in path:
                raise ValueError(f"factors need each other: {' > '.join((*path, name))}")
            if name not in self._factors:
                if name in columns:
                    return 0
                raise ValueError(f"{path[-1] if path else name}: neither a column nor a factor: {name}")
            if self._factors[name].status != "active":
                raise ValueError(f"factor {name} is {self._factors[name].status}")
            if name not in depth:
                depth[name] = 1 + max((visit(n, (*path, name)) for n in self._factors[name].needs), default=0)
            return depth[name]

        for name in factor_ids:
            visit(name, ())
        return [[self._factors[n] for n, d in depth.items() if d == k] for k in range(1, max(depth.values(), default=0) + 1)]

    def calculate(self, bars: DataFrame, factor_ids: Sequence[str] | None = None) -> DataFrame:
        """The bars with the factors asked for (default: all active ones) and what these need."""
        w = ordered(["symbol"], ["date"])
        for level in self.levels(self.names() if factor_ids is None else factor_ids, bars.columns):
            bars = bars.withColumns({f.factor_id: f.calculate(w) for f in level})
        return bars


def factor_panel(wide: DataFrame, factors: Sequence[str] = BUILT_IN, carry: Sequence[str] = ("fwd_ret",)) -> DataFrame:
    """Long form (factor_id, symbol, date, value, ...), aligned by key and without nulls."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("factor_id"), clean(F.col(f)).alias("value")) for f in factors])
    )
    return wide.select("symbol", "date", *carry, pairs.alias("p")).select(
        "p.factor_id", "symbol", "date", "p.value", *carry
    )


def composite_score(panel: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean of z-scored factors per (symbol, date).

    The z-score is taken over each symbol's own factor history. A factor a row lacks
    adds nothing; the divisor is the weight of all factors in use.
    """
    used = {f: float(v) for f, v in weights.items() if v > 0}
    total = sum(used.values())
    history = Window.partitionBy("factor_id", "symbol")
    spread = F.stddev_samp("value").over(history)
    centred = F.col("value") - F.avg("value").over(history)
    weight = F.create_map(*[F.lit(x) for kv in used.items() for x in kv])[F.col("factor_id")]
    scored = panel.where(F.col("factor_id").isin(list(used))).select(
        "symbol", "date", (F.when(spread > 0, centred / spread).otherwise(centred) * weight).alias("part")
    )
    return scored.groupBy("symbol", "date").agg((F.sum("part") / total).alias("score"))


def latest_values(panel: DataFrame, keep: int, keys: Sequence[str] = ("factor_id", "symbol")) -> DataFrame:
    """Append-only factor store: nulls dropped, the newest ``keep`` rows per series."""
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return (
        panel.where(F.col("value").isNotNull())
        .withColumn("__n", F.row_number().over(newest))
        .where(F.col("__n") <= keep)
        .drop("__n")
    )


def export_range(panel: DataFrame, factor_ids: Sequence[str], start, end) -> DataFrame:
    return panel.where(F.col("factor_id").isin(list(factor_ids)) & F.col("date").between(start, end))


def rank_factors(metrics: DataFrame, metric: str) -> DataFrame:
    """Factors by a metric, best first; one row per factor, so one small window."""
    best = Window.orderBy(F.col(metric).desc_nulls_last(), F.col("factor_id"))
    return metrics.select("factor_id", F.col(metric), F.row_number().over(best).alias("rank"))


def catalogue_statistics(catalogue: DataFrame) -> DataFrame:
    """Counts and mean IC / Sharpe by category, by status and over all."""
    return (
        catalogue.groupingSets(
            [[F.col("category")], [F.col("status")], []], F.col("category"), F.col("status")
        )
        .agg(
            F.count(F.lit(1)).alias("factors"),
            F.avg("ic").alias("avg_ic"),
            F.avg("sharpe").alias("avg_sharpe"),
        )
    )


def alerts(metrics: DataFrame) -> DataFrame:
    """One row per broken threshold of a factor."""
    checks: list[tuple[str, Column]] = [
        ("low_ic", F.abs("ic_mean") < 0.01),
        ("low_ic_ir", F.abs("ic_ir") < 0.3),
        ("high_turnover", F.col("turnover") > 1.5),
        ("low_coverage", F.col("coverage") < 0.8),
    ]
    raised = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return metrics.select("factor_id", *[c for c in ("symbol",) if c in metrics.columns], F.explode(raised).alias("alert"))


def system_alerts(metrics: DataFrame, min_active: int = 5, min_sharpe: float = 0.5) -> DataFrame:
    seen = metrics.agg(
        F.countDistinct("factor_id").alias("active"), F.avg("long_short_sharpe").alias("avg_sharpe")
    )
    raised = F.array_compact(
        F.array(
            F.when(F.col("active") < min_active, F.lit("few_active_factors")),
            F.when(F.col("avg_sharpe") < min_sharpe, F.lit("low_average_sharpe")),
        )
    )
    return seen.select(F.explode(raised).alias("alert"))


def deprecation_candidates(
    evaluations: DataFrame,
    periods: int = 10,
    min_ic: float = 0.02,
    min_ic_ir: float = 0.3,
    max_turnover: float = 2.0,
    min_coverage: float = 0.8,
) -> DataFrame:
    """Factors whose last ``periods`` evaluations fall short on average."""
    newest = Window.partitionBy("factor_id").orderBy(F.col("evaluated_on").desc())
    recent = (
        evaluations.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= periods)
    )
    means = recent.groupBy("factor_id").agg(
        F.avg(F.abs("ic")).alias("ic"),
        F.avg(F.abs("ic_ir")).alias("ic_ir"),
        F.avg("turnover").alias("turnover"),
        F.avg("coverage").alias("coverage"),
        F.count(F.lit(1)).alias("evaluations"),
    )
    poor = (
        (F.col("ic") < min_ic)
        | (F.col("ic_ir") < min_ic_ir)
        | (F.col("turnover") > max_turnover)
        | (F.col("coverage") < min_coverage)
    )
    return means.withColumn("deprecate", (F.col("evaluations") >= periods) & poor)


def select_factors(catalogue: DataFrame, status: str | None = None, category: str | None = None, quality: str | None = None) -> DataFrame:
    """Factors of a status, a category or a quality label."""
    out = catalogue
    for column, wanted in (("status", status), ("category", category), ("quality", quality)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return out
