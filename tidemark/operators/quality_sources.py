"""Source monitoring: missing, duplicate, outlying, stale and anomalous rows per source.

A source may hold a third of all rows, so every check is a grouped count, an exact
percentile over splits, or a top-n that Spark limits before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import flag, ratio
from tidemark.operators.quantiles import beside_keys, exact_quantiles

# Columns that tell when a row came in, not what it says.
CLOCK_COLUMNS = ("timestamp", "created_at", "updated_at", "_ingested_at")


def missing_rates(df: DataFrame, fields: Sequence[str], source: str = "source", limit: float = 0.05) -> DataFrame:
    """Share of null or empty values per source and field."""

    def empty(f: str):
        return flag(F.col(f).isNull() | (F.col(f).cast("string") == ""))

    rates = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(empty(f)).alias(f"__{f}") for f in fields]
    )
    per_field = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("missing")) for f in fields])
    )
    out = rates.select(source, "__n", per_field.alias("m")).select(
        source, "m.field", "m.missing", (F.col("m.missing") / F.col("__n")).alias("missing_rate")
    )
    return out.withColumn("issue", F.col("missing_rate") > limit)


def duplicate_rates(df: DataFrame, source: str = "source", limit: float = 0.01, ignore: Sequence[str] = CLOCK_COLUMNS) -> DataFrame:
    """Share of rows that repeat another one; copies are merged before they travel."""
    keys = [source, *[c for c in df.columns if c not in ignore and c != source]]
    merged = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    out = merged.groupBy(source).agg(
        F.sum("__c").alias("rows"), (F.sum("__c") - F.count(F.lit(1))).alias("duplicates")
    )
    out = out.withColumn("duplicate_rate", F.col("duplicates") / F.col("rows"))
    return out.withColumn("issue", F.col("duplicate_rate") > limit)


def outlier_rates(
    df: DataFrame,
    value: str,
    method: str = "iqr",
    threshold: float = 3.0,
    keys: Sequence[str] = ("source",),
    iqr_factor: float = 1.5,
    sample_std: bool = False,
    limit: float = 0.05,
    min_rows: int = 10,
) -> DataFrame:
    """Outliers of a numeric field by quartiles, z-score or modified z-score.

    Equal values are counted together before they meet the marks of their key.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    v = F.col("__v")
    if method == "iqr":
        marks = exact_quantiles(rows, keys, "__v", {"__q1": 0.25, "__q3": 0.75})
        spread = F.col("__q3") - F.col("__q1")
        odd = (v < F.col("__q1") - iqr_factor * spread) | (v > F.col("__q3") + iqr_factor * spread)
    elif method == "zscore":
        sd = F.stddev_samp("__v") if sample_std else F.stddev_pop("__v")
        marks = rows.groupBy(*keys).agg(F.avg("__v").alias("__m"), sd.alias("__s"))
        odd = F.abs(ratio(v - F.col("__m"), F.col("__s"))) > threshold
    elif method == "modified_zscore":
        middle = exact_quantiles(rows, keys, "__v", {"__med": 0.5})
        away = beside_keys(rows, middle, keys, "__v").select(*keys, F.abs(v - F.col("__med")).alias("__a"))
        mad = exact_quantiles(away, keys, "__a", {"__mad": 0.5})
        marks = middle.join(mad, keys)
        odd = F.abs(ratio(0.6745 * (v - F.col("__med")), F.col("__mad"))) > threshold
    else:
        raise ValueError(f"unknown method {method}")
    counted = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    out = beside_keys(counted, marks, keys, "__v").groupBy(*keys).agg(
        F.sum("__c").alias("values"), F.sum(flag(odd) * F.col("__c")).alias("outliers")
    )
    out = out.where(F.col("values") >= min_rows).withColumn("outlier_rate", F.col("outliers") / F.col("values"))
    return out.withColumn("issue", F.col("outlier_rate") > limit)


def stale_sources(df: DataFrame, as_of, max_age_seconds: int, source: str = "source", last: int = 10, tie: str = "event_id") -> DataFrame:
    """Any of the last rows older than the limit."""
    newest = Window.partitionBy(source).orderBy(F.col("ts").desc(), F.col(tie).desc())
    recent = df.select(source, "ts", tie).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last)
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("ts")
    return recent.groupBy(source).agg(
        F.max(age).alias("oldest_age"), F.max(flag(age > max_age_seconds)).cast("boolean").alias("stale")
    )


def volume_anomalies(df: DataFrame, source: str = "source", period: str = "1 day", limit: float = 0.5) -> DataFrame:
    """Change of the row count from one period to the next."""
    counts = df.groupBy(source, F.window("ts", period).start.alias("period")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.lag("rows").over(Window.partitionBy(source).orderBy("period"))
    out = counts.withColumn("change_rate", ratio(F.abs(F.col("rows") - before), before))
    return out.withColumn("issue", F.coalesce(F.col("change_rate") > limit, F.lit(False)))


def range_errors(df: DataFrame, field: str, low: float, high: float, source: str = "source") -> DataFrame:
    bad = (F.col(field) < low) | (F.col(field) > high)
    return df.groupBy(source).agg(
        F.sum(flag(bad)).alias("out_of_range"), F.avg(flag(bad)).alias("error_rate")
    ).where(F.col("out_of_range") > 0)


def format_errors(df: DataFrame, field: str, pattern: str, source: str = "source") -> DataFrame:
    bad = F.col(field).isNotNull() & ~F.col(field).rlike(pattern)
    return df.groupBy(source).agg(F.sum(flag(bad)).alias("malformed"), F.avg(flag(bad)).alias("malformed_rate"))


def source_metrics(
    df: DataFrame,
    fields: Sequence[str],
    ingested: str,
    value_range: tuple[str, float, float],
    consistency_key: Sequence[str],
    consistency_value: str,
    source: str = "source",
) -> DataFrame:
    """Completeness, latency, timeliness, accuracy, consistency, validity, overall.

    Accuracy is the share of values in range, validity the share of rows without an
    empty field, consistency the share of keys with one value only.
    """
    field, low, high = value_range
    empty = [flag(F.col(f).isNull() | (F.col(f).cast("string") == "")) for f in fields]
    empties = sum(empty[1:], empty[0])
    latency = F.unix_timestamp(ingested) - F.unix_timestamp("ts")
    main = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("record_count"),
        (1 - F.sum(empties) / (F.count(F.lit(1)) * len(fields))).alias("completeness"),
        F.avg(latency).alias("avg_latency"),
        F.max(latency).alias("max_latency"),
        F.avg(flag(F.col(field).between(low, high))).alias("accuracy"),
        F.avg(flag(empties == 0)).alias("validity"),
    )
    same = (
        df.groupBy(source, *consistency_key)
        .agg((F.min(consistency_value) == F.max(consistency_value)).alias("__same"))
        .groupBy(source)
        .agg(F.avg(flag(F.col("__same"))).alias("consistency"))
    )
    out = main.join(same, source)
    out = out.withColumn("timeliness", F.greatest(F.lit(0.0), 1 - F.col("avg_latency") / 60 / 60))
    return out.withColumn(
        "overall",
        0.25 * F.col("completeness")
        + 0.25 * F.col("accuracy")
        + 0.2 * F.col("consistency")
        + 0.15 * F.col("timeliness")
        + 0.15 * F.col("validity"),
    )


def overall_quality(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("sources"), F.avg("overall").alias("overall"))


def merge_issues(issues: DataFrame, gap: str = "1 hour", keys: Sequence[str] = ("rule", "source", "field")) -> DataFrame:
    """Issues of one rule, source and field join while the last is under ``gap`` old.

    Rows of one second merge first, so a storm of alike issues is one row per second;
    the session merge also runs before the shuffle.
    """
    per_second = issues.groupBy(*keys, F.date_trunc("second", "ts").alias("ts")).agg(F.sum("affected").alias("affected"))
    return (
        per_second.groupBy(*keys, F.session_window("ts", gap).alias("w"))
        .agg(F.sum("affected").alias("affected"))
        .select(*keys, F.col("w.start").alias("opened"), "affected")
    )


def resolve(issues: DataFrame, issue_id: str, notes: str, at) -> DataFrame:
    hit = F.col("issue_id") == issue_id
    return issues.withColumns(
        {
            "status": F.when(hit, "resolved").otherwise(F.col("status")),
            "resolved_at": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("resolved_at")),
            "notes": F.when(hit, F.lit(notes)).otherwise(F.col("notes")),
        }
    )
