"""Column helpers that carry the null, rank and rolling rules of the library."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Cells are cut just below the half, so an exact half never depends on the order
# in which a sum was taken.
GRID_OFFSET = 0.4871


def snap(x: Column, places: int = 6) -> Column:
    """Value on a decimal grid; null, NaN and infinities become null."""
    scale = float(10**places)
    return F.when(finite(x), F.floor(x * scale + GRID_OFFSET) / scale)


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clean(x: Column) -> Column:
    """NaN and infinities to null, once, at the door."""
    return F.when(finite(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b with null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def ordered(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def guarded(agg: Column, x: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Rolling aggregate, null until ``min_periods`` (default: n) non-null values are in."""
    frame = trailing(w, n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= need, agg.over(frame))


def roll_mean(x: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return guarded(F.avg(x), x, w, n, min_periods)


def roll_std(x: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return guarded(F.stddev_samp(x), x, w, n, min_periods)


def roll_sum(x: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return guarded(F.sum(x), x, w, n, min_periods)


def change(x: Column, w: WindowSpec, periods: int = 1) -> Column:
    """Relative change to ``periods`` rows earlier; ``x`` is padded forward beforehand."""
    return ratio(x, F.lag(x, periods).over(w)) - 1


def pad(df: DataFrame, name: str, w: WindowSpec) -> DataFrame:
    """Carry the last value forward over nulls."""
    return df.withColumn(name, F.last(clean(F.col(name)), ignorenulls=True).over(running(w)))


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank with ties on their mean; null stays null and takes no place."""
    nulls_last = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    ties = Window.partitionBy(*keys, x)
    return F.when(
        F.col(x).isNotNull(), F.rank().over(nulls_last) + (F.count(F.lit(1)).over(ties) - 1) / 2
    )


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 elsewhere, null counted as 0."""
    return F.when(cond, 1).otherwise(0)


def compounded(rate: Column, over: WindowSpec | None = None) -> Column:
    """Product of 1 + rate, as an aggregate or over a window: magnitude, sign and total losses
    are kept apart, as a logarithm has no place for a factor of 0 or below. Null without rates."""
    put = (lambda c: c) if over is None else (lambda c: c.over(over))
    one = 1 + rate
    size = F.coalesce(F.exp(put(F.sum(F.when(one != 0, F.log(F.abs(one)))))), F.lit(1.0))
    sign = F.when(put(F.sum(flag(one < 0))) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(put(F.count(rate)) > 0, F.when(put(F.max(flag(one == 0))) == 1, 0.0).otherwise(size * sign))


def either(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def ewm_means(df: DataFrame, w: WindowSpec, terms: dict[str, tuple[str, float]]) -> DataFrame:
    """Adjusted exponential means over all rows so far, as columns.

    ``terms`` maps an output name to (input column, span). The weighted sum over 2m
    rows is the one over m rows plus (1-a)^m times the same sum m rows earlier, so few lags
    of one window reach every weight a double can hold: doubling goes on, for each span,
    until the weight beyond is under 1e-17. Null inputs carry no weight but keep their
    place in time.
    """
    # One Window node per doubling serves every term; partition and sort stay the same.
    state = {}
    for out, (src, span) in terms.items():
        value = clean(F.col(src))
        state[out] = (f"__n_{out}", f"__d_{out}", 1.0 - 2.0 / (span + 1.0))
        df = df.withColumns(
            {
                f"__n_{out}": F.coalesce(value, F.lit(0.0)),
                f"__d_{out}": F.when(value.isNotNull(), 1.0).otherwise(0.0),
            }
        )
    step = 1
    while live := {c: keep**step for n, d, keep in state.values() if keep**step > 1e-17 for c in (n, d)}:
        df = df.withColumns({c: F.col(c) + F.lit(k) * F.coalesce(F.lag(c, step).over(w), F.lit(0.0)) for c, k in live.items()})
        step *= 2
    df = df.withColumns({out: ratio(F.col(n), F.col(d)) for out, (n, d, _) in state.items()})
    return df.drop(*[c for n, d, _ in state.values() for c in (n, d)])


def rolling_by_lags(df: DataFrame, w: WindowSpec, n: int, terms: dict[str, tuple[Column, str]]) -> DataFrame:
    """Rolling sums, minima or maxima over n rows in log2(n) steps.

    A sliding frame folds n rows again for every row. Here the fold over 2m rows is the
    fold over m rows joined with the one m rows earlier, so a row costs a few lags of a
    window that is partitioned and sorted once. Nothing is ever subtracted, so no digits
    are lost. Rows without n rows behind them hold partial folds; guard them by row count.
    """
    neutral = {"sum": F.lit(0.0), "min": F.lit(float("inf")), "max": F.lit(float("-inf"))}
    joins = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
    df = df.withColumns({f"__r0_{out}": F.coalesce(x.cast("double"), neutral[how]) for out, (x, how) in terms.items()})
    top = n.bit_length() - 1
    for k in range(top):
        df = df.withColumns(
            {
                f"__r{k + 1}_{out}": joins[how](
                    F.col(f"__r{k}_{out}"), F.coalesce(F.lag(f"__r{k}_{out}", 2**k).over(w), neutral[how])
                )
                for out, (_, how) in terms.items()
            }
        )
    done = {}
    for out, (_, how) in terms.items():
        fold, reach = F.col(f"__r{top}_{out}"), 2**top
        if how != "sum":
            # overlapping halves do no harm to a minimum or maximum
            done[out] = joins[how](fold, F.coalesce(F.lag(f"__r{top}_{out}", n - reach).over(w), neutral[how])) if n > reach else fold
            continue
        for k in range(top - 1, -1, -1):
            if n & (1 << k):
                fold = fold + F.coalesce(F.lag(f"__r{k}_{out}", reach).over(w), neutral[how])
                reach += 2**k
        done[out] = fold
    df = df.withColumns(done)
    return df.drop(*[f"__r{k}_{out}" for out in terms for k in range(top + 1)])


def rolling_correlation(df: DataFrame, a: str, b: str, out: str, keys: Sequence[str], order: Sequence[str], n: int, shift: int = 0) -> DataFrame:
    """Correlation over n rows ending ``shift`` rows back, null until n pairs are in or
    while either side is flat. Sides are centred on their series mean first."""
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    pair = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.col(a) - F.avg(a).over(whole), F.col(b) - F.avg(b).over(whole)
    df = df.withColumns({"__x": F.when(pair, x.cast("double")), "__y": F.when(pair, y.cast("double"))})
    x, y = F.col("__x"), F.col("__y")
    df = rolling_by_lags(
        df,
        w,
        n,
        {
            "__n": (F.when(x.isNotNull(), 1.0), "sum"),
            "__sx": (x, "sum"),
            "__sy": (y, "sum"),
            "__sxx": (x * x, "sum"),
            "__syy": (y * y, "sum"),
            "__sxy": (x * y, "sum"),
            "__lx": (x, "min"),
            "__hx": (x, "max"),
            "__ly": (y, "min"),
            "__hy": (y, "max"),
        },
    )
    c = F.col
    cov = c("__sxy") - c("__sx") * c("__sy") / n
    vx, vy = c("__sxx") - c("__sx") * c("__sx") / n, c("__syy") - c("__sy") * c("__sy") / n
    full = (c("__n") >= n) & (c("__lx") < c("__hx")) & (c("__ly") < c("__hy"))
    df = df.withColumn(out, F.when(full, clean(ratio(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))))
    if shift:
        df = df.withColumn(out, F.lag(out, shift).over(w))
    return df.drop("__x", "__y", "__n", "__sx", "__sy", "__sxx", "__syy", "__sxy", "__lx", "__hx", "__ly", "__hy")


def unnest(df: DataFrame, keep: Sequence[str], array: Column) -> DataFrame:
    """One row per struct of a computed array, its fields as columns.

    Spark puts a size test below a plain explode and pushes it into the projection, so
    a dear array would be computed again for the test; the outer form has no such test
    and the filter stays above it.
    """
    return df.select(*keep, F.explode_outer(array).alias("__e")).where(F.col("__e").isNotNull()).select(*keep, "__e.*")
