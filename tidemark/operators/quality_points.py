"""Quality checks of data points: row checks in one pass, batch checks by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import flag, total, unnest

# Accepted ranges per field.
RANGES = {
    "open": (0.01, 10000),
    "high": (0.01, 10000),
    "low": (0.01, 10000),
    "close": (0.01, 10000),
    "volume": (0, 1e12),
    "amount": (0, 1e15),
    "change_pct": (-20, 20),
    "turnover_rate": (0, 100),
}
# Fields a data type must carry.
REQUIRED = {
    "stock_price": ("open", "high", "low", "close", "volume"),
    "stock_info": ("name", "symbol"),
    "financial": ("revenue", "net_income"),
}
PENALTIES = {"critical": 0.5, "high": 0.3, "medium": 0.1, "low": 0.05}
ADVICE = {
    "missing_value": "check that the source delivers every required field",
    "out_of_range": "check units and limits of the source",
    "duplicate": "deduplicate before storing",
    "inconsistent": "compare with a second source",
    "outlier": "review the price outliers",
    "stale_data": "raise the update rate of the source",
    "incomplete": "backfill the missing period",
    "suspicious": "confirm the large moves",
    "invalid_value": "check the clock of the source",
}


VALUE_FIELDS = tuple(dict.fromkeys([*RANGES, *(f for fields in REQUIRED.values() for f in fields)]))


def _value(name: str) -> Column:
    return F.try_element_at(F.col("values"), F.lit(name))


def _opened(points: DataFrame) -> DataFrame:
    """Map entries as columns ``__<field>``, looked up once however many checks read them."""
    return points.withColumns({f"__{f}": _value(f) for f in VALUE_FIELDS})


def row_checks(as_of) -> list[tuple[Column, str, str, str]]:
    """(condition, issue type, severity, field) of every check of one opened point."""
    now = F.lit(as_of).cast("timestamp")
    price_type = F.col("data_type") == "stock_price"
    v = lambda f: F.col(f"__{f}")
    prices = ("open", "high", "low", "close")
    checks = [
        (F.col("symbol").isNull() | (F.col("symbol") == ""), "missing_value", "critical", "symbol"),
        (F.col("timestamp").isNull(), "missing_value", "critical", "timestamp"),
        (F.col("values").isNull() | (F.size("values") == 0), "incomplete", "critical", "values"),
    ]
    for kind, fields in REQUIRED.items():
        checks += [((F.col("data_type") == kind) & v(f).isNull(), "missing_value", "high", f) for f in fields]
    checks += [((v(f) < lo) | (v(f) > hi), "out_of_range", "medium", f) for f, (lo, hi) in RANGES.items()]
    checks += [(price_type & ~v(f).between(v("low"), v("high")), "inconsistent", "high", f) for f in ("open", "close")]
    checks.append((price_type & (F.abs(v("change_pct")) > 20), "suspicious", "medium", "change_pct"))
    checks += [((v(f) > 1000) | (v(f) < 0.01), "outlier", "medium", f) for f in prices]
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("timestamp")) / 86400)
    checks += [
        (F.col("timestamp") > now, "invalid_value", "high", "timestamp"),
        (age > 365, "stale_data", "low", "timestamp"),
    ]
    return checks


def point_issues(points: DataFrame, as_of) -> DataFrame:
    """One row per broken check. Checks that hold leave a null struct, which goes after
    the explode, so the whole test stays in generated code."""
    found = F.array(
        *[
            F.when(cond, F.struct(F.lit(kind).alias("issue_type"), F.lit(sev).alias("severity"), F.lit(field).alias("field")))
            for cond, kind, sev, field in row_checks(as_of)
        ]
    )
    return unnest(_opened(points), ["symbol", "timestamp"], found)


def duplicates(points: DataFrame) -> DataFrame:
    """Rows beyond the first per (symbol, timestamp, type); counted, never gathered."""
    return (
        points.groupBy("symbol", "timestamp", "data_type")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .where(F.col("extra") > 0)
    )


def continuity(points: DataFrame, max_days: int = 7) -> DataFrame:
    """Gaps of more than ``max_days`` inside a symbol.

    A gap spans days, so first and last instant per day are enough: at most one row per
    calendar day and symbol reaches the window.
    """
    days = points.groupBy("symbol", F.to_date("timestamp").alias("day")).agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    w = Window.partitionBy("symbol").orderBy("day")
    before = F.lag("last").over(w)
    gap = F.floor((F.unix_timestamp("first") - F.unix_timestamp(before)) / 86400)
    return days.withColumn("gap_days", gap).where(F.col("gap_days") > max_days).select(
        "symbol", F.col("day").alias("date"), "gap_days"
    )


def consistency(points: DataFrame) -> DataFrame:
    """Symbol-days whose close or volume differs between points."""
    close, volume = _value("close"), _value("volume")
    return (
        points.groupBy("symbol", F.to_date("timestamp").alias("date"))
        .agg(
            F.coalesce(F.min(close) != F.max(close), F.lit(False)).alias("close_differs"),
            F.coalesce(F.min(volume) != F.max(volume), F.lit(False)).alias("volume_differs"),
        )
        .where(F.col("close_differs") | F.col("volume_differs"))
    )


def freshness(points: DataFrame, as_of) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.max("timestamp"))) / 86400)
    return points.groupBy("source").agg(F.max("timestamp").alias("newest"), age.alias("age_days")).withColumn(
        "stale", F.col("age_days") > 1
    )


def score(points: DataFrame, as_of, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Score 1 - penalties / points, clipped; valid without a critical issue."""
    checks = row_checks(as_of)

    def count(severity: str) -> Column:
        return F.sum(total([flag(cond) for cond, _, sev, _ in checks if sev == severity]))

    out = _opened(points).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), *[count(s).alias(s) for s in PENALTIES]
    )
    penalty = sum((F.col(s) * p for s, p in PENALTIES.items()), F.lit(0.0))
    return out.withColumns(
        {
            "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - penalty / F.col("points"))),
            "valid": F.col("critical") == 0,
        }
    )


def issue_statistics(issues: DataFrame) -> DataFrame:
    """Counts per type, per severity and per field in one pass."""
    sets = [[F.col("issue_type")], [F.col("severity")], [F.col("field")], []]
    return issues.groupingSets(sets, F.col("issue_type"), F.col("severity"), F.col("field")).agg(
        F.count(F.lit(1)).alias("issues")
    )


def field_coverage(points: DataFrame) -> DataFrame:
    """Share of points with a value, per field."""
    whole = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    entries = points.select(F.explode("values").alias("field", "value"))
    held = entries.groupBy("field").agg(F.sum(flag(F.col("value").isNotNull())).alias("__k"))
    return held.select("field", (F.col("__k") / whole).alias("coverage"))


def recommendations(issues: DataFrame) -> DataFrame:
    """One line of advice per issue type that occurs."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issues")).withColumn(
        "advice", F.try_element_at(advice, F.col("issue_type"))
    )


def sane_points(points: DataFrame) -> Column:
    """Symbol, time and values present, every number between 0 and 1e10."""
    return (
        F.col("symbol").isNotNull()
        & (F.col("symbol") != "")
        & F.col("timestamp").isNotNull()
        & (F.size("values") > 0)
        & F.forall(F.map_values("values"), lambda x: x.isNull() | x.between(0, 1e10))
    )
