"""Filters that are more than one comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, ts: str, as_of, hours: float = 0, days: float = 0) -> DataFrame:
    """Rows of the time span that ends at ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(days=F.lit(int(days)), hours=F.lit(int(hours)))
    return df.where(F.col(ts).between(start, end))


def in_market(df: DataFrame, market: str, symbol: str = "symbol") -> DataFrame:
    return df.where(F.col(symbol).endswith(f".{market}"))


def sample_symbols(symbols: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n symbols in hash order: the same ones on every run and cluster size."""
    return symbols.select("symbol").distinct().orderBy(F.xxhash64("symbol", F.lit(seed)), "symbol").limit(n)


def subscribed(events: DataFrame, subscriptions: DataFrame, fields: Sequence[str], kind: str = "event_type") -> DataFrame:
    """Events fanned out to the subscriptions of their type whose filters they pass.

    A filter key the row lacks passes; a present one must be in the listed values, so a present null fails.
    ``subscriptions`` hold (subscription_id, kind, filters map<string, array<string>>).
    """
    row = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))
    fits = F.forall(
        F.map_entries("filters"),
        lambda e: ~F.map_contains_key(F.col("__row"), e["key"])
        | F.coalesce(F.array_contains(e["value"], F.try_element_at(F.col("__row"), e["key"])), F.lit(False)),
    )
    subs = subscriptions.withColumnRenamed("kind", kind)
    return events.withColumn("__row", row).join(subs, kind).where(fits).drop("__row")


def record_errors(rules: Mapping[str, Mapping]) -> Column:
    """Array of what is wrong with a record.

    Per field: ``type`` (a Spark type name), ``nullable``, ``min``, ``max``, ``allowed``.
    """
    checks = []
    for field, rule in rules.items():
        c = F.col(field)
        typed = c.try_cast(rule["type"]) if "type" in rule else c
        if not rule.get("nullable", True):
            checks.append(F.when(c.isNull(), F.lit(f"{field}: missing")))
        if "type" in rule:
            checks.append(F.when(c.isNotNull() & typed.isNull(), F.lit(f"{field}: type")))
        if "min" in rule:
            checks.append(F.when(typed < rule["min"], F.lit(f"{field}: below minimum")))
        if "max" in rule:
            checks.append(F.when(typed > rule["max"], F.lit(f"{field}: above maximum")))
        if "allowed" in rule:
            checks.append(F.when(c.isNotNull() & ~c.isin(list(rule["allowed"])), F.lit(f"{field}: not allowed")))
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame, rules: Mapping[str, Mapping]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest with their errors."""
    checked = df.withColumn("errors", record_errors(rules))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
