"""Factor weights: closed forms, cumulative windows, and recursive learners.

Input is long: (portfolio_id, factor_id, date, ret). A recursive learner walks one
portfolio's days in order; its group holds at most calendar days times catalogue factors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import clip, compounded, flag, ratio

DAY = ("portfolio_id", "date")


def normalise(df: DataFrame, column: str, keys: Sequence[str], out: str = "weight") -> DataFrame:
    whole = F.sum(column).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(whole > 0, F.col(column) / whole).otherwise(F.col(column)))


def _bounded(df: DataFrame, column: str, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Normalise, clip, normalise."""
    df = normalise(df, column, keys, "__w").withColumn("__w", clip(F.col("__w"), low, high))
    return normalise(df, "__w", keys).drop("__w")


def equal_weights(factors: DataFrame, keys: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    distinct = factors.select(*keys, "factor_id").distinct()
    return distinct.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def inverse_volatility(returns: DataFrame, keys: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    sd = returns.groupBy(*keys, "factor_id").agg(F.stddev_samp("ret").alias("__s"))
    return normalise(sd.withColumn("__i", ratio(F.lit(1.0), F.col("__s"))), "__i", keys).drop("__i", "__s")


def _so_far() -> Column:
    return Window.partitionBy("portfolio_id", "factor_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def thompson_counts(returns: DataFrame) -> DataFrame:
    """alpha = 1 + gains, beta = 1 + the rest, up to and with each day."""
    w = _so_far()
    return returns.withColumns(
        {"alpha": 1 + F.sum(flag(F.col("ret") > 0)).over(w), "beta": 1 + F.sum(flag(~(F.col("ret") > 0))).over(w)}
    )


def thompson_mean_weights(returns: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Weights from the mean of the Beta, which is what the draws average to."""
    df = thompson_counts(returns).withColumn("__m", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return _bounded(df, "__m", DAY, low, high).drop("__m")


def thompson_draw_weights(returns: DataFrame, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Weights from one Beta draw per row, seeded by the row's own key."""

    @F.pandas_udf("double")
    def draw(alpha: pd.Series, beta: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(
            [np.random.default_rng(int(k) & 0x7FFFFFFFFFFFFFFF).beta(a, b) for a, b, k in zip(alpha, beta, key)]
        )

    key = F.xxhash64("portfolio_id", "factor_id", "date", F.lit(seed))
    df = thompson_counts(returns).withColumn("__d", draw("alpha", "beta", key))
    return _bounded(df, "__d", DAY, low, high).drop("__d")


def ucb_weights(returns: DataFrame, exploration: float = 0.1, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Mean return so far plus sqrt(2 ln T / n), soft-maxed by the exploration rate.

    A factor without a return so far has twice the best finite value.
    """
    w = _so_far()
    days = Window.partitionBy("portfolio_id").orderBy("date")
    df = returns.withColumns(
        {"__n": F.count("ret").over(w), "__m": F.avg("ret").over(w), "__t": F.dense_rank().over(days)}
    )
    value = F.when(F.col("__n") > 0, F.col("__m") + F.sqrt(2 * F.ln("__t") / F.col("__n")))
    df = df.withColumn("__v", value)
    day = Window.partitionBy(*DAY)
    top = F.max("__v").over(day)
    df = df.withColumn("__u", F.coalesce("__v", 2 * top))
    # shifting by the largest value leaves the soft-max as it is and keeps exp in range
    df = df.withColumn("__e", F.coalesce(F.exp((F.col("__u") - F.max("__u").over(day)) / exploration), F.lit(1.0)))
    return _bounded(df, "__e", DAY, low, high).drop("__n", "__m", "__t", "__v", "__u", "__e")


# --- recursive learners -----------------------------------------------------------------

Step = Callable[[np.ndarray, float, dict], np.ndarray]


def learn(returns: DataFrame, make_step: Callable[[int], Step]) -> DataFrame:
    """Walk each portfolio's days; a step maps (returns, portfolio return, state) to the
    new weights. The portfolio return uses the weights of the day before."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="date", columns="factor_id", values="ret").sort_index().fillna(0.0)
        k = wide.shape[1]
        weights = np.full(k, 1.0 / k)
        step, state = make_step(k), {"weights": weights}
        rows, port = [], []
        for r in wide.to_numpy():
            earned = float(weights @ r)
            weights = step(r, earned, state)
            state["weights"] = weights
            rows.append(weights)
            port.append(earned)
        out = pd.DataFrame(rows, index=wide.index, columns=wide.columns).stack().rename("weight").reset_index()
        earned = pd.Series(port, index=wide.index, name="portfolio_ret")
        out = out.merge(earned.reset_index(), on="date")
        out["portfolio_id"] = frame["portfolio_id"].iloc[0]
        return out[["portfolio_id", "factor_id", "date", "weight", "portfolio_ret"]]

    kind = returns.schema["portfolio_id"].dataType.simpleString()
    return returns.groupBy("portfolio_id").applyInPandas(
        walk, f"portfolio_id {kind}, factor_id string, date date, weight double, portfolio_ret double"
    )


def _scaled(w: np.ndarray) -> np.ndarray:
    return w / w.sum() if w.sum() > 0 else w


def gradient_step(rate: float = 0.01, low: float = 0.0, high: float = 1.0) -> Callable[[int], Step]:
    """w + rate / sqrt(t) * (r - portfolio return), clipped and normalised."""

    def make(k: int) -> Step:
        def step(r, earned, state):
            state["t"] = state.get("t", 0) + 1
            moved = state["weights"] + rate / np.sqrt(state["t"]) * (r - earned)
            return _scaled(np.clip(moved, low, high))

        return step

    return make


def momentum_step(rate: float = 0.01, momentum: float = 0.9) -> Callable[[int], Step]:
    def make(k: int) -> Step:
        def step(r, earned, state):
            state["v"] = momentum * state.get("v", np.zeros(k)) + rate * r
            moved = state["weights"] + state["v"]
            whole = np.abs(moved).sum()
            return moved / whole if whole > 0 else moved

        return step

    return make


def ewma_step(rate: float = 0.01) -> Callable[[int], Step]:
    """(1 - rate) w + rate |r / sum r|, normalised; a zero sum only normalises."""

    def make(k: int) -> Step:
        def step(r, earned, state):
            w, whole = state["weights"], r.sum()
            if whole != 0:
                w = (1 - rate) * w + rate * np.abs(r / whole)
            return _scaled(w)

        return step

    return make


def rls_step(forget: float = 0.99, start: float = 1000.0) -> Callable[[int], Step]:
    """Recursive least squares of the portfolio return on the factor returns."""

    def make(k: int) -> Step:
        def step(x, earned, state):
            p = state.setdefault("P", start * np.eye(k))
            theta = state.setdefault("theta", np.zeros(k))
            px = p @ x
            gain = px / (forget + x @ px)
            state["theta"] = theta + gain * (earned - x @ theta)
            state["P"] = (p - np.outer(gain, px)) / forget
            return _scaled(np.abs(state["theta"]))

        return step

    return make


def bandit_step(epsilon: float = 0.1, seed: int = 0) -> Callable[[int], Step]:
    """Soft-max of mean rewards r * w; a random Dirichlet at rate epsilon."""

    def make(k: int) -> Step:
        rng = np.random.default_rng(seed)

        def step(r, earned, state):
            state["n"] = state.get("n", 0) + 1
            state["sum"] = state.get("sum", np.zeros(k)) + r * state["weights"]
            if rng.random() < epsilon:
                return rng.dirichlet(np.ones(k))
            mean = state["sum"] / state["n"]
            if mean.max() > mean.min():
                e = np.exp(mean - mean.max())
                return e / e.sum()
            return np.full(k, 1.0 / k)

        return step

    return make


def ucb_feedback_step(confidence: float = 2.0) -> Callable[[int], Step]:
    """Mean of r * w plus confidence * sqrt(ln T / n), soft-maxed."""

    def make(k: int) -> Step:
        def step(r, earned, state):
            state["n"] = state.get("n", 0) + 1
            state["sum"] = state.get("sum", np.zeros(k)) + r * state["weights"]
            value = state["sum"] / state["n"] + confidence * np.sqrt(np.log(state["n"]) / state["n"])
            e = np.exp(value - value.max())
            return e / e.sum()

        return step

    return make


def regression_weights(wide: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """Absolute coefficients of a linear fit on standardised factors, normalised."""
    data = VectorAssembler(inputCols=list(factors), outputCol="__x").transform(wide.dropna(subset=[*factors, target]))
    fit = LinearRegression(featuresCol="__x", labelCol=target, standardization=True, solver="normal").fit(data)
    spread = wide.agg(*[F.stddev_samp(f).alias(f) for f in factors]).first()
    size = [abs(float(c)) * (spread[f] or 0.0) for c, f in zip(fit.coefficients, factors)]
    whole = sum(size) or 1.0
    return wide.sparkSession.createDataFrame(
        [(f, s / whole) for f, s in zip(factors, size)], "factor_id string, weight double"
    )


# --- learning metrics -------------------------------------------------------------------


def learning_metrics(daily: DataFrame) -> DataFrame:
    """Running Sharpe, drawdown and hit rate of (portfolio_id, date, portfolio_ret)."""
    w = Window.partitionBy("portfolio_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("portfolio_ret")
    df = daily.withColumns({"__g": compounded(r, w), "__n": F.count(r).over(w)})
    df = df.withColumn("__peak", F.max("__g").over(w))
    sd = F.stddev_pop(r).over(w)
    df = df.withColumn("__dd", ratio(F.col("__g") - F.col("__peak"), F.col("__peak")))
    return df.select(
        "portfolio_id",
        "date",
        F.when((F.col("__n") > 1) & (sd > 0), F.avg(r).over(w) / sd).otherwise(0.0).alias("sharpe"),
        F.min("__dd").over(w).alias("max_drawdown"),
        F.avg(flag(r > 0)).over(w).alias("hit_rate"),
    )


def convergence(weights: DataFrame) -> DataFrame:
    """1 / (1 + 10 * mean variance of the last ten weights); 0 before ten days."""
    w = Window.partitionBy("portfolio_id", "factor_id").orderBy("date").rowsBetween(-9, 0)
    df = weights.withColumns({"__v": F.var_pop("weight").over(w), "__n": F.count("weight").over(w)})
    return df.groupBy(*DAY).agg(
        F.when(F.min("__n") >= 10, 1 / (1 + F.avg("__v") * 10)).otherwise(0.0).alias("convergence")
    )


def learning_rates(scores: DataFrame, rate: float = 0.01) -> DataFrame:
    """Rate x .95 above .8 and x 1.05 below .3, held in [.001, .1] day by day."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        now, out = rate, []
        for s in frame["convergence"]:
            now = min(max(now * (0.95 if s > 0.8 else 1.05 if s < 0.3 else 1.0), 0.001), 0.1)
            out.append(now)
        frame["learning_rate"] = out
        return frame

    kind = scores.schema["portfolio_id"].dataType.simpleString()
    return scores.groupBy("portfolio_id").applyInPandas(
        walk, f"portfolio_id {kind}, date date, convergence double, learning_rate double"
    )


def importance(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean reward r * w per factor."""
    on = ["portfolio_id", "factor_id", "date"]
    return returns.join(weights.select(*on, "weight"), on).groupBy("portfolio_id", "factor_id").agg(
        F.avg(F.col("ret") * F.col("weight")).alias("importance")
    )


def rebalance_days(days: DataFrame, every: int, keys: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    """First day, then each day at least ``every`` days after the last one kept."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates().sort_values("date")
        kept, last = [], None
        for d in frame["date"]:
            take = last is None or (d - last).days >= every
            kept.append(take)
            last = d if take else last
        return frame[kept]

    picked = days.select(*keys, "date").distinct()
    return picked.groupBy(*keys).applyInPandas(walk, picked.schema)


def rebalance_statistics(turnover: DataFrame) -> DataFrame:
    return turnover.agg(
        F.count(F.lit(1)).alias("rebalances"), F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost")
    )


def active_only(returns: DataFrame, catalogue: DataFrame) -> DataFrame:
    return returns.join(catalogue.where(F.col("status") == "active").select("factor_id"), "factor_id", "left_semi")


def learn_active(returns: DataFrame, catalogue: DataFrame, make_step: Callable[[int], Step], seq: Column) -> DataFrame:
    """Weights learnt on the active factors only, as rows of the weight history: ``seq``
    tells one run from the next. A portfolio without an active factor gets no new weights."""
    return learn(active_only(returns, catalogue), make_step).withColumn("learnt", seq)
