"""Portfolio, risk and back-test operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import compounded, flag, ratio

# One-sided normal quantiles as the reports give them; other levels are computed.
Z_SCORES = {0.95: 1.645, 0.99: 2.326, 0.90: 1.282}


def growth(returns: DataFrame, keys: Sequence[str], order: str, ret: str = "ret") -> DataFrame:
    """Compounded growth, its running peak and the drawdown, from the first return on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("growth", compounded(F.col(ret), w))
    df = df.withColumn("peak", F.max("growth").over(w))
    return df.withColumn("drawdown", ratio(F.col("growth") - F.col("peak"), F.col("peak")))


def price_drawdown(prices: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "date", price: str = "close") -> DataFrame:
    """Drawdown from the running maximum of the price, from the first price on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = prices.withColumn("peak", F.max(price).over(w))
    return df.withColumn("drawdown", ratio(F.col(price) - F.col("peak"), F.col("peak")))


def drawdown_report(prices: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "date", price: str = "close") -> DataFrame:
    """Largest drawdown with peak and trough positions and the current one.

    Positions count returns from 0; growth telescopes to price over the first price.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    df = prices.withColumns(
        {"__i": F.row_number().over(w) - 2, "__g": ratio(F.col(price), F.first(price).over(up_to))}
    ).where(F.col("__i") >= 0)
    df = df.withColumn("__peak", F.max("__g").over(up_to))
    df = df.withColumns(
        {
            "__dd": ratio(F.col("__g") - F.col("__peak"), F.col("__peak")),
            "__at": F.max(F.when(F.col("__g") == F.col("__peak"), F.col("__i"))).over(up_to),
        }
    )
    # First row on which the running peak took its present level.
    df = df.withColumn("__since", F.min("__i").over(Window.partitionBy(*keys, "__peak")))
    low = F.struct("__dd", "__i")
    return df.groupBy(*keys).agg(
        F.min("__dd").alias("max_drawdown"),
        F.min_by("__since", low).cast("int").alias("peak_idx"),
        F.min_by("__i", low).cast("int").alias("trough_idx"),
        F.max_by("__dd", "__i").alias("current_drawdown"),
    )


def top_k(signals: DataFrame, k: int, keys: Sequence[str] = ("date",), score: str = "score", tie: str = "symbol") -> DataFrame:
    """Best k per key; Spark keeps only k rows per key and task before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return signals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def backtest_returns(signals: DataFrame, forward: DataFrame, k: int) -> DataFrame:
    """Equal-weight daily return of the k best signals; a missing return counts 0."""
    chosen = top_k(signals, k)
    joined = chosen.join(forward.select("date", "symbol", "ret"), ["date", "symbol"], "left")
    return joined.groupBy("date").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("ret"))


def backtest_summary(daily: DataFrame, max_drawdown: Column | None = None) -> DataFrame:
    mean, std = F.avg("ret"), F.stddev_pop("ret")
    return daily.agg(
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
        F.coalesce(std, F.lit(0.0)).alias("std"),
        F.coalesce(mean * 252, F.lit(0.0)).alias("annualized_return"),
        F.coalesce(F.when(std > 0, mean * 252 / (std * math.sqrt(252))), F.lit(0.0)).alias("information_ratio"),
        (F.lit(0.0) if max_drawdown is None else max_drawdown).alias("max_drawdown"),
    )


def performance(returns: DataFrame, keys: Sequence[str] = ("portfolio_id",), benchmark: str | None = None) -> DataFrame:
    """Return, volatility, Sharpe, drawdown, Calmar, tracking error, IR and hit rate."""
    path = growth(returns, keys, "date")
    if benchmark:
        path = path.withColumn("__x", F.col("ret") - F.col(benchmark))
    year = math.sqrt(252)
    sd = F.stddev_pop("ret")
    aggs = [
        (compounded(F.col("ret")) - 1).alias("total_return"),
        (sd * year).alias("volatility"),
        F.when(sd > 0, F.avg("ret") / sd * year).otherwise(0.0).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(flag(F.col("ret") > 0)).alias("hit_rate"),
    ]
    if benchmark:
        xs = F.stddev_pop("__x")
        aggs += [
            (xs * year).alias("tracking_error"),
            F.when(xs > 0, F.avg("__x") / xs * year).otherwise(0.0).alias("information_ratio"),
        ]
    out = path.groupBy(*keys).agg(*aggs)
    return out.withColumn(
        "calmar_ratio",
        F.when(F.col("max_drawdown") < 0, F.col("total_return") / F.abs("max_drawdown")).otherwise(0.0),
    )


def return_statistics(returns: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Win rate, Sharpe, drawdown, Calmar and one-sample t of a return series."""
    path = growth(returns, keys, "date")
    s = F.stddev_samp("ret")
    out = path.groupBy(*keys).agg(
        F.avg(flag(F.col("ret") > 0)).alias("win_rate"),
        F.when(s > 0, F.avg("ret") / s * math.sqrt(252)).otherwise(0.0).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        (F.avg("ret") * 252).alias("__ann"),
        F.when(s > 0, F.avg("ret") / (s / F.sqrt(F.count("ret")))).alias("t_stat"),
    )
    return out.withColumn(
        "calmar_ratio", F.when(F.col("max_drawdown") != 0, F.col("__ann") / F.abs("max_drawdown")).otherwise(0.0)
    ).drop("__ann")


def value_at_risk(returns: DataFrame, confidence: float = 0.95, method: str = "historical", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """VaR, the mean of the returns at or below it, and the extremes."""
    r = F.col("ret")
    if method == "historical":
        # exact percentile keeps a count per distinct return, merged map-side
        var = F.percentile(r, F.lit(1 - confidence))
    elif method == "parametric":
        var = F.avg(r) - (Z_SCORES.get(confidence) or NormalDist().inv_cdf(confidence)) * F.stddev_pop(r)
    else:
        raise ValueError(f"unknown method {method}")
    level = returns.groupBy(*keys).agg(var.alias("var"), F.min(r).alias("worst_return"), F.max(r).alias("best_return"))
    tail = (
        returns.join(level.select(*keys, "var"), list(keys))
        .where(r <= F.col("var"))
        .groupBy(*keys)
        .agg(F.avg(r).alias("cvar"))
    )
    return level.join(tail, list(keys), "left").withColumn("cvar", F.coalesce("cvar", "var"))


def covariance(panel: DataFrame, series: str, ret: str = "ret", min_rows: int = 10, last: int | None = 252) -> DataFrame:
    """Sample covariance of every pair of series over the dates both have.

    The series of one date are gathered into one row; a date holds one entry per
    series name, so the row is bounded by the catalogue.
    """
    df = panel.where(F.col(ret).isNotNull())
    if last is not None:
        # the window holds distinct dates only: at most the calendar
        dates = df.select("date").distinct().orderBy(F.col("date").desc()).limit(last)
        df = df.join(dates, "date", "left_semi")
    rows = df.groupBy("date").agg(F.collect_list(F.struct(F.col(series).alias("id"), F.col(ret).alias("v"))).alias("f"))
    pairs = rows.select("f", F.explode("f").alias("a")).select("a", F.explode("f").alias("b"))
    return (
        pairs.groupBy(F.col("a.id").alias("left"), F.col("b.id").alias("right"))
        .agg(F.covar_samp("a.v", "b.v").alias("covariance"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_rows)
    )


def weight_turnover(old: DataFrame, new: DataFrame, cost_rate: float = 0.001, keys: Sequence[str] = ()) -> DataFrame:
    """Half the absolute weight change, and its cost."""
    on = [*keys, "factor_id"]
    both = old.select(*on, F.col("weight").alias("__o")).join(new.select(*on, F.col("weight").alias("__n")), on, "full")
    moved = F.sum(F.abs(F.coalesce("__n", F.lit(0.0)) - F.coalesce("__o", F.lit(0.0)))) / 2
    out = both.groupBy(*keys).agg(moved.alias("turnover"))
    return out.withColumn("cost", F.col("turnover") * cost_rate)


def correlation(df: DataFrame, a: str, b: str, keys: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation per key with its t statistic; Spearman on average ranks."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = a, b
    if method == "spearman":
        rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (
            F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1
        ) / 2
        both = both.withColumns({"__x": rank(a), "__y": rank(b)})
        x, y = "__x", "__y"
    out = both.groupBy(*keys).agg(F.corr(x, y).alias("correlation"), F.count(F.lit(1)).alias("n"))
    r = F.col("correlation")
    t = F.when(F.abs(r) < 1, r * F.sqrt(ratio(F.col("n") - 2, 1 - r * r)))
    return out.withColumn("t_stat", t).withColumn("significant", F.abs("t_stat") > 1.96)
