"""Market regimes by rules, by likelihood, by mixture and by vote."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import change, ewm_means, ordered, ratio, roll_mean, roll_std
from tidemark.operators.features import rsi_from

FEATURES = (
    "return_1d", "return_5d", "return_20d", "volatility_20d", "volatility_60d", "rsi", "macd", "volume_ratio", "vix",
    "yield_spread", "momentum_12m", "drawdown",
)
# The regimes in their order, which settles ties.
REGIMES = ("bull_market", "bear_market", "sideways", "high_vol", "low_vol", "crisis", "recovery")
# Bounds of each rule. A drawdown bound is taken as written: bull asks for
# one of at least 5 percent, crisis for one of at most 20 percent.
RULES = {
    "crisis": {"return_5d_max": -0.10, "volatility_20d_min": 0.30, "vix_min": 35, "drawdown_min": -0.20},
    "high_vol": {"volatility_20d_min": 0.25, "vix_min": 25},
    "bull_market": {"return_20d_min": 0.02, "volatility_20d_max": 0.15, "rsi_min": 50, "drawdown_max": -0.05},
    "bear_market": {"return_20d_max": -0.02, "volatility_20d_min": 0.15, "rsi_max": 50, "drawdown_min": -0.15},
}
RULE_CONFIDENCE = {"crisis": 0.9, "high_vol": 0.8, "bull_market": 0.8, "bear_market": 0.8, "sideways": 0.6}


def mended(rules: Mapping[str, Mapping[str, float]] = RULES) -> dict[str, dict[str, float]]:
    """The same rules with the drawdown bounds of bull and crisis turned round."""
    out = {k: dict(v) for k, v in rules.items()}
    out["bull_market"]["drawdown_min"] = out["bull_market"].pop("drawdown_max")
    out["crisis"]["drawdown_max"] = out["crisis"].pop("drawdown_min")
    return out


def regime_features(bars: DataFrame) -> DataFrame:
    """Twelve features as of every row; what is not yet defined is 0."""
    w = ordered(["symbol"], ["date"])
    c = F.col("close")
    df = ewm_means(bars, w, {"__e12": ("close", 12), "__e26": ("close", 26)})
    df = df.withColumns(
        {
            "return_1d": change(c, w),
            "__gain": F.greatest(F.coalesce(c - F.lag("close").over(w), F.lit(0.0)), F.lit(0.0)),
            "__loss": F.greatest(F.coalesce(F.lag("close").over(w) - c, F.lit(0.0)), F.lit(0.0)),
            "__peak": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    year = math.sqrt(252)
    df = df.withColumns(
        {
            "return_5d": change(c, w, 5),
            "return_20d": change(c, w, 20),
            "momentum_12m": change(c, w, 252),
            "volatility_20d": roll_std(F.col("return_1d"), w, 20) * year,
            "volatility_60d": roll_std(F.col("return_1d"), w, 60) * year,
            "rsi": rsi_from(roll_mean(F.col("__gain"), w, 14), roll_mean(F.col("__loss"), w, 14)),
            "macd": F.col("__e12") - F.col("__e26"),
            "volume_ratio": ratio(F.col("volume"), roll_mean(F.col("volume"), w, 20)),
            "drawdown": ratio(c - F.col("__peak"), F.col("__peak")),
            "yield_spread": F.lit(0.02),
        }
    )
    df = df.withColumn("vix", F.col("volatility_20d") * 100)
    df = df.drop("__e12", "__e26", "__gain", "__loss", "__peak")
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES})


def by_rules(rules: Mapping[str, Mapping[str, float]] = RULES) -> Column:
    """First rule that holds, in the order of the rules."""
    out = None
    for regime, bounds in rules.items():
        holds = F.lit(True)
        for bound, limit in bounds.items():
            feature, side = bound.rsplit("_", 1)
            holds = holds & ((F.col(feature) >= limit) if side == "min" else (F.col(feature) <= limit))
        out = F.when(holds, regime) if out is None else out.when(holds, regime)
    return out.otherwise("sideways")


def rule_confidence(regime: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RULE_CONFIDENCE.items() for x in kv])[regime]


def likelihoods() -> dict[str, Column]:
    def times(*parts: tuple[Column, float]) -> Column:
        out = F.lit(1.0)
        for cond, factor in parts:
            out = out * F.when(cond, factor).otherwise(1.0)
        return out

    r20, r5, v, c = F.col("return_20d"), F.col("return_5d"), F.col("volatility_20d"), F.col
    return {
        "bull_market": times((r20 > 0.01, 2.0), (v < 0.15, 1.5), (c("rsi") > 50, 1.3)),
        "bear_market": times((r20 < -0.01, 2.0), (v > 0.15, 1.5), (c("rsi") < 50, 1.3)),
        "sideways": F.lit(1.0),
        "high_vol": times((v > 0.25, 3.0), (c("vix") > 25, 2.0)),
        "low_vol": F.lit(1.0),
        "crisis": times((r5 < -0.05, 2.5), (v > 0.30, 2.0), (c("drawdown") < -0.15, 2.0)),
        "recovery": F.lit(1.0),
    }


def by_likelihood(df: DataFrame) -> DataFrame:
    """Probabilities p_<regime> under a uniform prior, the likeliest regime and its chance."""
    like = likelihoods()
    df = df.withColumns({f"__l_{k}": x for k, x in like.items()})
    whole = sum((F.col(f"__l_{k}") for k in REGIMES[1:]), F.col(f"__l_{REGIMES[0]}"))
    df = df.withColumns({f"p_{k}": F.col(f"__l_{k}") / whole for k in REGIMES}).drop(*[f"__l_{k}" for k in REGIMES])
    top = F.greatest(*[F.col(f"p_{k}") for k in REGIMES])
    pick = F.coalesce(*[F.when(F.col(f"p_{k}") == top, k) for k in REGIMES])
    return df.withColumns({"likely_regime": pick, "likely_probability": top})


def map_state() -> Column:
    r, v, d = F.col("return_20d"), F.col("volatility_20d"), F.col("drawdown")
    return (
        F.when((d < -0.20) | (v > 0.30), "crisis")
        .when(v > 0.25, "high_vol")
        .when(r > 0.02, "bull_market")
        .when(r < -0.02, "bear_market")
        .otherwise("sideways")
    )


def by_mixture(df: DataFrame, components: int = 4, seed: int = 7) -> DataFrame:
    """Gaussian mixture fitted on the history; a row's regime follows from its features
    and its confidence from the mixture."""
    vec = VectorAssembler(inputCols=list(FEATURES), outputCol="__raw").transform(df)
    scaled = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(vec).transform(vec)
    model = GaussianMixture(featuresCol="__x", predictionCol="mixture_state", probabilityCol="__p", k=components, seed=seed, maxIter=30).fit(scaled)
    out = model.transform(scaled).withColumn("mixture_confidence", F.array_max(vector_to_array("__p")))
    return out.drop("__raw", "__x", "__p").withColumn("mixture_regime", map_state())


def by_vote(df: DataFrame, mixture: bool = False) -> DataFrame:
    """Weighted vote: rules .4, likelihood .3, mixture .3 where it was fitted.

    Expects the columns of ``by_likelihood`` and, with ``mixture``, of ``by_mixture``.
    """
    df = df.withColumn("rule_regime", by_rules())
    voters = [("rule_regime", rule_confidence(F.col("rule_regime")), 0.4)]
    if mixture:
        voters.append(("mixture_regime", F.col("mixture_confidence"), 0.3))
    voters.append(("likely_regime", F.col("likely_probability"), 0.3))
    total = sum(weight for _, _, weight in voters)
    votes = {
        name: sum((F.when(F.col(other) == F.col(name), conf * weight).otherwise(0.0) for other, conf, weight in voters), F.lit(0.0))
        for name, _, _ in voters
    }
    top = F.greatest(*votes.values())
    pick = F.coalesce(*[F.when(v == top, F.col(name)) for name, v in votes.items()])
    return df.withColumns({"regime": pick, "confidence": top / total})
