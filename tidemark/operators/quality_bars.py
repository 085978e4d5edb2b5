"""Quality rules of landed bars: all rules of a symbol from one grouped pass.

Rows first shrink to one per (symbol, date), which counts every cell and duplicate;
rules that look along time then see at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import flag, ratio, total

PRICES = ("open", "high", "low", "close")


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    metric: str
    threshold: float = 0.0
    enabled: bool = True


DEFAULT_RULES = (
    Rule("missing_data", "warning", "missing_ratio", 0.05),
    Rule("duplicate_dates", "error", "duplicate_dates"),
    Rule("future_dates", "error", "future_dates"),
    Rule("non_trading_days", "warning", "non_trading_days"),
    Rule("negative_prices", "error", "negative_prices"),
    Rule("zero_prices", "warning", "zero_prices"),
    Rule("price_outliers", "warning", "price_outliers"),
    Rule("ohlc_consistency", "error", "ohlc_errors"),
    Rule("extreme_returns", "warning", "extreme_returns"),
    Rule("negative_volume", "error", "negative_volume"),
    Rule("zero_volume_days", "warning", "zero_volume_ratio", 0.10),
    Rule("volume_outliers", "warning", "volume_outliers"),
    Rule("data_gaps", "warning", "data_gaps"),
    Rule("price_jumps", "warning", "price_jumps"),
)


class RuleSet:
    """The rules in force; users add, switch on and switch off."""

    def __init__(self, rules: Sequence[Rule] = DEFAULT_RULES) -> None:
        self.rules = {r.name: r for r in rules}

    def add(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def switch(self, name: str, on: bool) -> bool:
        if name not in self.rules:
            return False
        self.rules[name] = replace(self.rules[name], enabled=on)
        return True

    def active(self) -> list[Rule]:
        return [r for r in self.rules.values() if r.enabled]


def bar_metrics(
    bars: DataFrame,
    as_of,
    calendar: DataFrame | None = None,
    seq: str = "seq",
    extreme: float = 0.20,
    jump: float = 0.15,
    gap_days: int = 5,
    price_sigma: float = 3.0,
    volume_sigma: float = 5.0,
) -> DataFrame:
    """Every rule's measure per symbol. ``seq`` says which of several rows of a day is last."""
    cells = [*PRICES, "volume"]
    col = F.col
    daily = bars.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(total([flag(col(c).isNull()) for c in cells])).alias("nulls"),
        F.sum(total([flag(col(c) < 0) for c in PRICES])).alias("negative_prices"),
        F.sum(total([flag(col(c) == 0) for c in PRICES])).alias("zero_prices"),
        F.sum(
            flag(col("high") < F.greatest("open", "close")) + flag(col("low") > F.least("open", "close"))
        ).alias("ohlc_errors"),
        F.sum(flag(col("volume") < 0)).alias("negative_volume"),
        F.sum(flag(col("volume") == 0)).alias("zero_volume"),
        *[F.max_by(c, seq).alias(c) for c in ("open", "close", "volume")],
    )
    along = Window.partitionBy("symbol").orderBy("date")
    whole = Window.partitionBy("symbol")
    prev = F.lag("close").over(along)

    def z(c: str) -> Column:
        return F.abs(ratio(col(c) - F.avg(c).over(whole), F.stddev_samp(c).over(whole)))

    daily = daily.withColumns(
        {
            "ret": ratio(col("close"), prev) - 1,
            "jump": F.abs(ratio(col("open"), prev) - 1),
            "pz": z("close"),
            "vz": z("volume"),
        }
    )
    if calendar is not None:
        days = calendar.select("date", "idx")
        daily = daily.join(days, "date", "left")
        daily = daily.withColumn("gap", col("idx") - F.lag("idx").over(along))
    else:
        daily = daily.withColumns({"idx": F.lit(0), "gap": F.lit(None).cast("int")})
    n = F.sum("rows")
    return daily.groupBy("symbol").agg(
        n.alias("total_records"),
        (F.sum("nulls") / (n * len(cells))).alias("missing_ratio"),
        (n - F.count(F.lit(1))).alias("duplicate_dates"),
        F.sum(flag(col("date") > F.lit(as_of).cast("date")) * col("rows")).alias("future_dates"),
        F.sum(flag(col("idx").isNull())).alias("non_trading_days"),
        *[F.sum(c).alias(c) for c in ("negative_prices", "zero_prices", "ohlc_errors", "negative_volume")],
        (F.sum("zero_volume") / n).alias("zero_volume_ratio"),
        F.sum(flag(F.abs("ret") > extreme)).alias("extreme_returns"),
        F.max("ret").alias("max_return"),
        F.min("ret").alias("min_return"),
        F.sum(flag(col("pz") > price_sigma)).alias("price_outliers"),
        F.sum(flag(col("vz") > volume_sigma)).alias("volume_outliers"),
        F.sum(flag(col("gap") > gap_days)).alias("data_gaps"),
        F.sum(flag(col("jump") > jump)).alias("price_jumps"),
    )


def issues(metrics: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per broken rule."""
    rules = RuleSet().active() if rules is None else rules
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(r.metric) > r.threshold,
                    F.struct(
                        F.lit(r.name).alias("rule"),
                        F.lit(r.severity).alias("severity"),
                        F.col(r.metric).cast("double").alias("value"),
                        F.lit(r.threshold).alias("threshold"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return metrics.select("symbol", F.explode(found).alias("i")).select("symbol", "i.*")


def with_missing_symbols(metrics_issues: DataFrame, found: DataFrame, requested: DataFrame) -> DataFrame:
    """Add a ``no_data`` error for every requested symbol without a row."""
    absent = requested.select("symbol").distinct().join(found.select("symbol").distinct(), "symbol", "left_anti")
    none = absent.select(
        "symbol",
        F.lit("no_data").alias("rule"),
        F.lit("error").alias("severity"),
        F.lit(0.0).alias("value"),
        F.lit(0.0).alias("threshold"),
    )
    return metrics_issues.unionByName(none)


def health(issue_rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Errors and warnings per symbol; healthy means no error."""
    counts = issue_rows.groupBy("symbol").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    out = symbols.select("symbol").distinct().join(counts, "symbol", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("healthy", F.col("errors") == 0)


def summary(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.count_if("healthy").alias("healthy_symbols"),
        F.count_if(F.col("errors") > 0).alias("symbols_with_errors"),
        F.count_if(F.col("warnings") > 0).alias("symbols_with_warnings"),
        F.sum(F.col("errors") + F.col("warnings")).alias("total_issues"),
    )


def symbol_reports(metrics: DataFrame, issue_rows: DataFrame, state: DataFrame) -> DataFrame:
    """One report for each symbol asked for: counts, its issues in order, and its metrics (null without data)."""
    found = issue_rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rule", "severity", "value", "threshold"))).alias("issues"))
    measured = metrics.select("symbol", F.struct(*[c for c in metrics.columns if c != "symbol"]).alias("metrics"))
    return state.join(found, "symbol", "left").join(measured, "symbol", "left")


def save_reports(reports: DataFrame, state: DataFrame, folder: str) -> None:
    """Reports of the symbols and their summary as JSON below ``folder``."""
    reports.write.mode("overwrite").json(f"{folder}/symbols")
    summary(state).write.mode("overwrite").json(f"{folder}/summary")


def breakdown(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.groupBy("rule").agg(F.count(F.lit(1)).alias("issues")).orderBy(F.desc("issues"), "rule")


def top_issues(issue_rows: DataFrame, n: int = 10) -> DataFrame:
    return (
        issue_rows.where(F.col("severity") == "error")
        .orderBy(F.coalesce("value", F.lit(0.0)).desc(), "symbol", "rule")
        .limit(n)
    )


def by_severity(issue_rows: DataFrame, severity: str) -> DataFrame:
    return issue_rows.where(F.col("severity") == severity)


def usable_symbols(bars: DataFrame, start, end, min_days: int = 100, max_null_ratio: float = 0.5) -> DataFrame:
    """Symbols with enough rows and few enough empty cells in the range."""
    cells = [*PRICES, "volume"]
    inside = bars.where(F.col("date").between(start, end))
    stats = inside.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(total([flag(F.col(c).isNull()) for c in cells])).alias("nulls"),
    )
    stats = stats.withColumn("null_ratio", F.col("nulls") / (F.col("rows") * len(cells)))
    return stats.where((F.col("rows") >= min_days) & (F.col("null_ratio") <= max_null_ratio)).drop("nulls")


# --- cleaning -----------------------------------------------------------------------


def fill_gaps(df: DataFrame, column: str, how: str, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Forward, backward or linear fill, or drop, along one bounded series."""
    if how == "drop":
        return df.where(F.col(column).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    behind = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    if how == "forward":
        return df.withColumn(column, F.last(column, ignorenulls=True).over(behind))
    if how == "backward":
        return df.withColumn(column, F.first(column, ignorenulls=True).over(ahead))
    if how != "interpolate":
        raise ValueError(f"unknown fill {how}")
    df = df.withColumn("__i", F.row_number().over(w))
    at = F.when(F.col(column).isNotNull(), F.col("__i"))
    df = df.withColumns(
        {
            "__v0": F.last(column, ignorenulls=True).over(behind),
            "__v1": F.first(column, ignorenulls=True).over(ahead),
            "__i0": F.last(at, ignorenulls=True).over(behind),
            "__i1": F.first(at, ignorenulls=True).over(ahead),
        }
    )
    step = ratio((F.col("__v1") - F.col("__v0")) * (F.col("__i") - F.col("__i0")), F.col("__i1") - F.col("__i0"))
    # past the last value the line stays level; before the first it stays empty
    filled = F.coalesce(F.col(column), F.col("__v0") + F.coalesce(step, F.lit(0.0)))
    return df.withColumn(column, filled).drop("__i", "__v0", "__v1", "__i0", "__i1")


def adjust_prices(df: DataFrame, factor: str = "adj_factor", how: str = "qfq") -> DataFrame:
    """Forward (against the newest factor) or backward adjusted prices."""
    f = F.col(factor)
    if how == "qfq":
        newest = Window.partitionBy("symbol").orderBy("date").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        f = ratio(f, F.last(factor).over(newest))
    elif how != "hfq":
        raise ValueError(f"unknown adjustment {how}")
    return df.withColumn("__f", f).withColumns({p: F.col(p) * F.col("__f") for p in PRICES}).drop("__f")
