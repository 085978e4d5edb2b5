"""Feature validation rules, profiles and validation reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import flag, ratio
from tidemark.operators.quality_sources import outlier_rates
from tidemark.operators.quantiles import exact_quantiles

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.DecimalType)


def type_matches(df: DataFrame, expected: Mapping[str, str]) -> dict[str, bool]:
    """Schema check only, no job: numeric types are alike, text types are alike."""
    out = {}
    for name, want in expected.items():
        have = df.schema[name].dataType
        if want in ("numeric", "double", "float", "long", "int"):
            out[name] = isinstance(have, NUMERIC)
        elif want in ("string", "text", "categorical"):
            out[name] = isinstance(have, T.StringType)
        else:
            out[name] = have.simpleString() == want
    return out


def long_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    )
    return df.select(pairs.alias("p")).select("p.*")


def profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, nulls, distinct, range, moments and quartiles per feature."""
    values = long_form(df, features)
    # distinct values are counted as groups, so no task holds a set of them
    merged = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("__c"))
    distinct = merged.where(F.col("value").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))
    stats = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(flag(F.col("value").isNull())).alias("nulls"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    quartiles = exact_quantiles(values, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return stats.join(distinct, "feature", "left").join(quartiles, "feature", "left")


def histogram(df: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width counts per feature; the top edge belongs to the last bin."""
    values = long_form(df, features).where(F.col("value").isNotNull())
    edge = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.coalesce(F.floor(ratio(F.col("value") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1))
    # one row for each feature of the list, so the values stay where they are
    placed = values.join(F.broadcast(edge), "feature").select("feature", place.cast("int").alias("bin"))
    return placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("rows"))


def basic_rules(df: DataFrame, features: Sequence[str], low: float, high: float, max_null: float = 0.1, min_unique: float = 0.01) -> DataFrame:
    """Range, null-ratio and unique-ratio rules of every feature."""
    p = profile(df, features)
    values = long_form(df, features)
    outside = values.groupBy("feature").agg(
        F.sum(flag(F.col("value") < low)).alias("below"), F.sum(flag(F.col("value") > high)).alias("above")
    )
    out = p.join(outside, "feature").withColumns(
        {
            "null_ratio": F.col("nulls") / F.col("rows"),
            "unique_ratio": F.col("distinct") / F.col("rows"),
        }
    )
    return out.select(
        "feature",
        "below",
        "above",
        "min",
        "max",
        "null_ratio",
        "unique_ratio",
        ((F.col("below") + F.col("above")) == 0).alias("range_ok"),
        (F.col("null_ratio") <= max_null).alias("nulls_ok"),
        (F.col("unique_ratio") >= min_unique).alias("unique_ok"),
    )


def outlier_rule(df: DataFrame, features: Sequence[str], method: str, threshold: float, max_ratio: float = 0.05) -> DataFrame:
    out = outlier_rates(
        long_form(df, features), "value", method, threshold, ["feature"], iqr_factor=threshold, sample_std=True,
        limit=max_ratio, min_rows=1,
    )
    return out.withColumn("passed", ~F.col("issue")).drop("issue")


def distribution_rule(df: DataFrame, features: Sequence[str], min_rows: int = 8) -> DataFrame:
    """Normality by Jarque-Bera: JB over 2 is exponential under the null."""
    stats = long_form(df, features).groupBy("feature").agg(
        F.count("value").alias("n"), F.skewness("value").alias("__s"), F.kurtosis("value").alias("__k")
    )
    jb = F.col("n") / 6 * (F.col("__s") ** 2 + F.col("__k") ** 2 / 4)
    return stats.where(F.col("n") >= min_rows).select(
        "feature", "n", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"), (F.exp(-jb / 2) > 0.05).alias("passed")
    )


def kolmogorov_p(distance: Column, n: Column, terms: int = 100) -> Column:
    """The chance of a distance so large: Kolmogorov's alternating series, 1 below where it settles."""
    reach = F.sqrt(n) * distance
    each = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * reach * reach))
    return F.when(reach < 0.2, 1.0).otherwise(F.least(F.greatest(F.aggregate(each, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)), F.lit(1.0)))


# fixed values: complementary error function as exp of a polynomial (relative error below 1.2e-7)
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_share(z: Column) -> Column:
    """Share of the standard normal below ``z``, in expressions that Spark compiles."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = c + t * power
    tail = 0.5 * t * F.exp(-x * x + power)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def kolmogorov(df: DataFrame, value: str, keys: Sequence[str], against: str = "normal", significance: float = 0.05) -> DataFrame:
    """Kolmogorov distance to a fitted distribution, its p-value and the verdict.

    ``normal`` has the mean and sample deviation of the key, ``uniform`` its least and
    largest value; keys without spread give no distance. Equal values are merged. Values
    are cut into bands of the fitted share; counts of the bands below give the offset of
    each band, so a window covers a band of a key and not the key. The p-value is the
    asymptotic one.
    """
    if against not in ("normal", "uniform"):
        raise ValueError(f"no test against {against}")
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if against == "normal":
        fit, scale = (F.avg("__v"), F.stddev_samp("__v")), F.col("__scale")
    else:
        fit, scale = (F.min("__v"), F.max("__v")), F.col("__scale") - F.col("__from0")
    edge = rows.groupBy(*keys).agg(fit[0].alias("__from0"), fit[1].alias("__scale"), F.count(F.lit(1)).alias("n"))
    merged = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    x = ratio(F.col("__v") - F.col("__from0"), scale)
    placed = merged.join(edge, keys).withColumn("__x", normal_share(x) if against == "normal" else x)
    placed = placed.withColumn("__b", F.floor(F.col("__x") * 256))
    bands = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__m"))
    below = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(*keys, "__b", F.coalesce(F.sum("__m").over(below), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(bands, [*keys, "__b"]).withColumn("__end", F.col("__from") + F.sum("__c").over(inside))
    d = F.greatest(
        F.abs(F.col("__end") / F.col("n") - F.col("__x")),
        F.abs((F.col("__end") - F.col("__c")) / F.col("n") - F.col("__x")),
    )
    out = ranked.groupBy(*keys, "n").agg(F.max(d).alias("ks_distance")).withColumn("p_value", kolmogorov_p(F.col("ks_distance"), F.col("n")))
    return out.withColumn("passed", F.col("p_value") > significance)


def uniform_ks(df: DataFrame, value: str, keys: Sequence[str], significance: float = 0.05) -> DataFrame:
    return kolmogorov(df, value, keys, "uniform", significance)


SHAPIRO_ROWS = 5000
# fixed values: polynomials of the approximation by Royston (1995), rising powers
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
FEW_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
MANY_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
MANY_SPREAD = (-0.4803, -0.082676, 0.0030302)
FEW_SHIFT = (-2.273, 0.459)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p-value of 8 to 5000 values; a constant is told as (1, 1)."""
    poly = np.polynomial.polynomial.polyval
    x, n = np.sort(values), len(values)
    around = x - x.mean()
    spread = around @ around
    if spread == 0:
        return 1.0, 1.0
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    length = m @ m
    last = poly(n**-0.5, LAST_WEIGHT) + m[-1] / math.sqrt(length)
    before = poly(n**-0.5, NEXT_WEIGHT) + m[-2] / math.sqrt(length)
    rest = (length - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
    a = m / math.sqrt(rest)
    a[[0, 1, -2, -1]] = -last, -before, before, last
    w = min((a @ x) ** 2 / spread, 1.0)
    if w == 1.0:
        return 1.0, 1.0
    if n < 12:
        score = -math.log(poly(n, FEW_SHIFT) - math.log(1 - w)) if poly(n, FEW_SHIFT) > math.log(1 - w) else math.inf
        z = (score - poly(n, FEW_MEAN)) / math.exp(poly(n, FEW_SPREAD))
    else:
        z = (math.log(1 - w) - poly(math.log(n), MANY_MEAN)) / math.exp(poly(math.log(n), MANY_SPREAD))
    return w, 0.0 if math.isinf(z) else normal.cdf(-z)


def distribution_test(
    df: DataFrame, value: str, keys: Sequence[str], against: str = "normal", significance: float = 0.05, min_rows: int = 8
) -> DataFrame:
    """The distribution rule: method, statistic, p-value and verdict of each key.

    Normality of up to 5000 values is Shapiro and Wilk's W, which orders a key in one
    task; larger keys and the uniform take the Kolmogorov distance. Keys of fewer than
    ``min_rows`` values are not tested and pass; large ones without spread, and the null
    key, are not tested and fail if not few. These have null statistics.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    exact = SHAPIRO_ROWS if against == "normal" else 0
    many = rows.join(sizes.where((F.col("n") >= min_rows) & (F.col("n") > exact)).select(*keys), keys, "left_semi")
    told = kolmogorov(many, "__v", keys, against, significance).select(
        *keys, F.lit("kolmogorov").alias("method"), F.col("ks_distance").alias("statistic"), "p_value", "passed"
    )
    if exact:
        small = rows.join(sizes.where(F.col("n").between(min_rows, exact)).select(*keys), keys, "left_semi")

        def test(frame: pd.DataFrame) -> pd.DataFrame:
            w, p = shapiro_wilk(frame["__v"].to_numpy())
            return frame[keys].iloc[:1].assign(method="shapiro", statistic=w, p_value=p, passed=p > significance)

        told = told.unionByName(small.groupBy(*keys).applyInPandas(test, told.schema))
    return sizes.join(told, keys, "left").select(
        *keys, "n", F.coalesce("method", F.lit("none")).alias("method"), "statistic", "p_value",
        F.coalesce("passed", F.col("n") < min_rows).alias("passed"),
    )


def custom_rules(df: DataFrame, rules: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """User rules as aggregate conditions: one row per rule with its verdict."""
    verdict = df.agg(*[rule().cast("boolean").alias(name) for name, rule in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("passed")) for n in rules]))
    return verdict.select(each.alias("r")).select("r.*")


def report(results: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(frame with feature and passed, rule, level, category) to success rates.

    A feature is valid unless a rule of level error or critical failed.
    """
    parts = [
        frame.select("feature", "passed", F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.lit(category).alias("category"))
        for frame, rule, level, category in results
    ]
    merged = reduce(DataFrame.unionByName, parts)
    grave = ~F.col("passed") & F.col("level").isin("error", "critical")
    return merged.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rules"),
        F.avg(flag(F.col("passed"))).alias("success_rate"),
        F.sum(flag(~F.col("passed") & (F.col("level") == "warning"))).alias("failed_warnings"),
        (F.sum(flag(grave)) == 0).alias("valid"),
    )
