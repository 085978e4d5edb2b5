"""Factor evaluation: IC, regression, quantile back-test, turnover, quality.

``keys`` name one factor series, by default a factor on a symbol. Every window runs
inside a series, which is never longer than the calendar, and all of them share the
hash partitioning of the series keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import clean, clip, finite, flag, ratio, rolling_correlation, total
from tidemark.operators.portfolio import growth
from tidemark.session import cut_lineage

SERIES = ("factor_id", "symbol")


def _rank_ic(window: int):
    """Grouped function: rank IC of one series over the ``window`` rows before each row."""

    def per_series(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", ignore_index=True)
        out = np.full(len(frame), np.nan)
        if len(frame) > window:
            sides = []
            for c in ("value", "fwd_ret"):
                views = np.lib.stride_tricks.sliding_window_view(frame[c].to_numpy(), window)[:-1]
                ranks = pd.DataFrame(views).rank(axis=1).to_numpy()
                sides.append(ranks - (window + 1) / 2)
            scale = np.sqrt((sides[0] ** 2).sum(axis=1) * (sides[1] ** 2).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[window:] = np.where(scale > 0, (sides[0] * sides[1]).sum(axis=1) / scale, np.nan)
        frame["rank_ic"] = out
        return frame

    return per_series


def rolling_ic(panel: DataFrame, window: int = 60, keys: Sequence[str] = SERIES, spearman: bool = True) -> DataFrame:
    """Pearson and rank IC over the ``window`` rows before each row.

    Ranks inside a sliding window have no built-in form: one series, at most the
    calendar long, goes to numpy as it is, not as one array of ``window`` per row.
    """
    df = rolling_correlation(panel, "value", "fwd_ret", "ic", keys, ["date"], window, shift=1)
    if spearman:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", rank_ic double"
        df = df.groupBy(*keys).applyInPandas(_rank_ic(window), schema)
        df = df.withColumns({"ic": clean(F.col("ic")), "rank_ic": clean(F.col("rank_ic"))})
    return df


def ic_summary(rolling: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean, population deviation, IR and win rate; no window gives 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ir = lambda c: zero(F.when(F.stddev_pop(c) > 0, F.avg(c) / F.stddev_pop(c)))
    out = [
        zero(F.avg("ic")).alias("ic_mean"),
        zero(F.stddev_pop("ic")).alias("ic_std"),
        ir("ic").alias("ic_ir"),
        zero(F.avg(F.when(F.col("ic").isNotNull(), flag(F.col("ic") > 0)))).alias("ic_win_rate"),
    ]
    if "rank_ic" in rolling.columns:
        out += [
            zero(F.avg("rank_ic")).alias("rank_ic_mean"),
            zero(F.stddev_pop("rank_ic")).alias("rank_ic_std"),
            ir("rank_ic").alias("rank_ic_ir"),
        ]
    return rolling.groupBy(*keys).agg(*out)


def descriptive(panel: DataFrame, keys: Sequence[str] = ("factor_id",)) -> DataFrame:
    v = F.col("value")
    return panel.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
        F.avg(F.when(finite(v), 1.0).otherwise(0.0)).alias("coverage"),
    )


#: Steps of the continued fraction: enough for some ten thousand degrees of freedom.
_STEPS = 240


def student_p(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t: the regularised incomplete beta I(df / 2, 1 / 2) at df / (df + t^2).

    The fraction is taken on the side on which it converges. The quotient of gamma functions in
    front of it is shifted up by 30 and then an asymptotic series, exact to 1e-13. Null without
    a degree of freedom or a t.
    """
    a, half = df / 2.0, F.lit(0.5)
    x = df / (df + t * t)
    z = a + 30
    gamma = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * z**3) - 21 / (32768 * z**4) - 399 / (262144 * z**5))
    for k in range(30):
        gamma = gamma * ((a + k) / (a + k + 0.5))
    front = F.exp(a * F.log(x)) * F.sqrt(t * t / (df + t * t)) * gamma / math.sqrt(math.pi)
    near = x < (a + 1) / (a + 2.5)
    p, q, y = F.when(near, a).otherwise(half), F.when(near, half).otherwise(a), F.when(near, x).otherwise(t * t / (df + t * t))

    def fraction(p: Column, q: Column, y: Column) -> Column:
        safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

        def step(s: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            # named one after the other, so that each is computed once
            first = F.transform(F.array(F.struct((1 / safe(1 + even * s["d"])).alias("d"), safe(1 + even / s["c"]).alias("c"))), lambda e: F.struct(e["d"].alias("d"), e["c"].alias("c"), (s["h"] * e["d"] * e["c"]).alias("h")))[0]
            return F.transform(F.array(first), lambda e: F.transform(F.array(F.struct((1 / safe(1 + odd * e["d"])).alias("d"), safe(1 + odd / e["c"]).alias("c"))), lambda o: F.struct(o["d"].alias("d"), o["c"].alias("c"), (e["h"] * o["d"] * o["c"]).alias("h")))[0])[0]

        d = 1 / safe(1 - (p + q) * y / (p + 1))
        start = F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h"))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(_STEPS)), lambda m: m.cast("double")), start, step, lambda s: s["h"])

    part = front * fraction(p, q, y) / p
    return F.when((df > 0) & t.isNotNull(), F.when(t == 0, 1.0).when(near, part).otherwise(1 - part))


def regression(panel: DataFrame, keys: Sequence[str] = ("factor_id",)) -> DataFrame:
    """Least squares of the return on the factor; t from the correlation."""
    y, x = F.col("fwd_ret"), F.col("value")
    fit = panel.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("factor_loading"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("__r"),
        F.count(F.lit(1)).alias("n"),
    )
    r = F.col("__r")
    t = r * F.sqrt(ratio(F.col("n") - 2, 1 - r * r))
    fit = fit.withColumns({"r_squared": r * r, "t_stat": t}).drop("__r")
    return fit.withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 2).cast("double")))


def information_coefficient(panel: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Pearson and rank IC of a whole series, t statistic and label."""
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1
    ) / 2
    both = panel.where(F.col("value").isNotNull() & F.col("fwd_ret").isNotNull())
    ranked = both.withColumns({"__rv": rank("value"), "__rr": rank("fwd_ret")})
    ic = clean(F.corr("value", "fwd_ret"))
    out = ranked.groupBy(*keys).agg(
        ic.alias("ic"), clean(F.corr("__rv", "__rr")).alias("rank_ic"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumns(
        {
            "t_stat": F.when(
                F.abs("ic") < 1, F.col("ic") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("ic") * F.col("ic")))
            ),
            "ic_quality": F.when(F.abs("ic") > 0.1, "excellent")
            .when(F.abs("ic") > 0.05, "good")
            .when(F.abs("ic") > 0.02, "average")
            .otherwise("poor"),
        }
    )


def bucketed(panel: DataFrame, n: int = 5, keys: Sequence[str] = SERIES) -> DataFrame:
    """Equal groups by factor value; the last one takes the remainder."""
    by_value = Window.partitionBy(*keys).orderBy("value", "date")
    size = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / n)
    df = panel.withColumns({"__rn": F.row_number().over(by_value), "__size": size})
    bucket = F.least(F.floor((F.col("__rn") - 1) / F.col("__size")), F.lit(n - 1)).cast("int")
    df = df.where(F.col("__size") > 0).withColumn("bucket", bucket)
    return df.withColumn("pos", (F.col("__rn") - 1 - F.col("bucket") * F.col("__size")).cast("int")).drop(
        "__rn", "__size"
    )


def bucket_means(buckets: DataFrame, n: int = 5, keys: Sequence[str] = SERIES) -> DataFrame:
    return buckets.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("bucket") == i, F.col("fwd_ret"))).alias(f"q{i + 1}") for i in range(n)]
    )


def monotonicity(n: int = 5) -> Column:
    steps = [F.col(f"q{i + 2}") - F.col(f"q{i + 1}") for i in range(n - 1)]
    up, down = total([flag(s > 0) for s in steps]), total([flag(s < 0) for s in steps])
    return F.greatest(up, down) / (n - 1)


def long_short(buckets: DataFrame, n: int = 5, keys: Sequence[str] = SERIES, risk_free: float = 0.03) -> DataFrame:
    """i-th return of the top group less the i-th of the bottom one, and its risk."""
    ends = buckets.where(F.col("bucket").isin(0, n - 1)).groupBy(*keys, "pos").agg(
        F.max(F.when(F.col("bucket") == n - 1, F.col("fwd_ret"))).alias("__top"),
        F.max(F.when(F.col("bucket") == 0, F.col("fwd_ret"))).alias("__low"),
    )
    spread = ends.where(F.col("__top").isNotNull() & F.col("__low").isNotNull()).select(
        *keys, "pos", (F.col("__top") - F.col("__low")).alias("ret")
    )
    path = growth(spread, keys, "pos")
    vol = F.stddev_pop("ret") * math.sqrt(252)
    return path.groupBy(*keys).agg(
        vol.alias("long_short_volatility"),
        F.when(vol > 0, (F.avg("ret") * 252 - risk_free) / vol).otherwise(0.0).alias("long_short_sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )


def turnover(panel: DataFrame, lag: int = 1, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean relative change and lag-k autocorrelation of the factor."""
    w = Window.partitionBy(*keys).orderBy("date")
    df = panel.withColumns({"__p": F.lag("value").over(w), "__l": F.lag("value", lag).over(w)})
    return df.groupBy(*keys).agg(
        F.coalesce(
            F.avg(F.when(F.col("__p") != 0, F.abs(F.col("value") - F.col("__p")) / F.abs("__p"))), F.lit(0.0)
        ).alias("turnover"),
        F.coalesce(
            clean(F.corr("value", "__l")), F.lit(0.0)
        ).alias("auto_correlation"),
    )


def quality_score() -> Column:
    """Weights .3/.2/.2/.1/.1/.1 over scores clipped to [0, 1]."""
    return (
        0.3 * clip(F.abs("ic_ir") / 2, 0, 1)
        + 0.2 * clip(F.abs("rank_ic_ir") / 2, 0, 1)
        + 0.2 * clip(F.abs("long_short_sharpe") / 3, 0, 1)
        + 0.1 * F.col("monotonicity")
        + 0.1 * F.col("coverage")
        + 0.1 * F.abs(F.col("ic_win_rate") - 0.5) * 2
    )


def quality_label(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "excellent")
        .when(score >= 0.6, "good")
        .when(score >= 0.4, "average")
        .when(score >= 0.2, "poor")
        .otherwise("invalid")
    )


def evaluate(panel: DataFrame, window: int = 60, n: int = 5, min_periods: int = 20, keys: Sequence[str] = SERIES) -> DataFrame:
    """All metrics of every factor series with at least ``min_periods`` rows."""
    # six metrics read the panel; it is written once so the raw rows are read once
    both = cut_lineage(panel.where(F.col("value").isNotNull() & F.col("fwd_ret").isNotNull()))
    buckets = bucketed(both, n, keys)
    means = bucket_means(buckets, n, keys).select(
        *keys, (F.col(f"q{n}") - F.col("q1")).alias("long_short_return"), monotonicity(n).alias("monotonicity")
    )
    out = descriptive(both, keys)
    for part in (
        ic_summary(rolling_ic(both, window, keys), keys),
        regression(both, keys).drop("n"),
        means,
        long_short(buckets, n, keys),
        turnover(both, 1, keys),
    ):
        out = out.join(part, list(keys), "left")
    out = out.where(F.col("n") >= min_periods).withColumn("quality_score", quality_score())
    return out.withColumn("quality", quality_label(F.col("quality_score")))


def evaluation_summary(metrics: DataFrame) -> DataFrame:
    """Counts per quality label, averages, and the best series."""
    labels = ("excellent", "good", "average", "poor", "invalid")
    return metrics.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(flag(F.col("quality") == q)).alias(q) for q in labels],
        *[
            F.avg(c).alias(f"avg_{c}")
            for c in ("ic_ir", "rank_ic_ir", "long_short_sharpe", "turnover", "coverage", "quality_score")
        ],
        F.max_by("factor_id", F.struct("quality_score", "factor_id")).alias("best_factor"),
    )


def factor_correlation(panel: DataFrame, min_periods: int = 20) -> DataFrame:
    """Pairwise correlation of factors over the rows both have.

    The factors of one (symbol, date) are gathered into a map first, so the pairs are
    built inside a row and no self-join of the panel is needed. The list of factors in
    a row is the catalogue, a set of names, never data.
    """
    rows = panel.where(F.col("value").isNotNull()).groupBy("symbol", "date").agg(
        F.sort_array(F.collect_list(F.struct("factor_id", "value"))).alias("f")
    )
    left = rows.select("f", F.explode("f").alias("a"))
    pairs = left.select("a", F.explode("f").alias("b")).where(F.col("a.factor_id") <= F.col("b.factor_id"))
    return (
        pairs.groupBy(F.col("a.factor_id").alias("factor_a"), F.col("b.factor_id").alias("factor_b"))
        .agg(F.corr("a.value", "b.value").alias("correlation"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_periods)
    )
