"""Feature groups as tables: validated upsert, reads by key and time, delete, expiry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.predicates import split_valid
from tidemark.session import cut_lineage
from tidemark.sources.store import keep_last, read_table


@dataclass(frozen=True)
class FeatureGroup:
    """Declared features with their checks, the key, and an optional lifetime."""

    name: str
    keys: tuple[str, ...]
    rules: Mapping[str, Mapping] = field(default_factory=dict)
    ttl_seconds: int | None = None


class FeatureStore:
    """One Parquet folder per group, newest row per key, bucketed by a hash of the key."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets
        self.groups: dict[str, FeatureGroup] = {}

    def register(self, group: FeatureGroup) -> None:
        self.groups[group.name] = group

    def names(self) -> list[str]:
        return sorted(self.groups)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _bucket(self, group: FeatureGroup):
        return F.pmod(F.xxhash64(*group.keys), F.lit(self.buckets)).cast("int")

    def put(self, name: str, records: DataFrame, stamp, validate: bool = True) -> DataFrame:
        """Store the valid rows; return the others with their errors."""
        group = self.groups[name]
        good, bad = split_valid(records, group.rules) if validate else (records, records.where(F.lit(False)))
        new = good.withColumns({"_timestamp": F.lit(stamp).cast("timestamp"), "_bucket": self._bucket(group)})
        old = read_table(self.spark, self._path(name))
        rows = new
        if old is not None:
            # buckets without a new row stay as they are on disk
            touched = new.select("_bucket").distinct()
            rows = new.unionByName(old.join(touched, "_bucket", "left_semi"), allowMissingColumns=True)
        self._write(keep_last(rows, list(group.keys), "_timestamp"), name)
        return bad

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "_bucket"
        ).parquet(self._path(name))

    def _read(self, name: str) -> DataFrame:
        group = self.groups[name]
        df = read_table(self.spark, self._path(name))
        if df is None:
            raise KeyError(f"feature group {group.name} holds nothing")
        return df

    def get(self, name: str, keys: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        group = self.groups[name]
        found = self._read(name).join(keys.select(*group.keys).distinct(), list(group.keys), "left_semi").drop("_bucket")
        return found if features is None else found.select(*group.keys, *features)

    def history(self, name: str, start, end, features: Sequence[str] | None = None) -> DataFrame:
        group = self.groups[name]
        rows = self._read(name).where(F.col("_timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
        return rows.drop("_bucket") if features is None else rows.select(*group.keys, "_timestamp", *features)

    def live(self, name: str, as_of) -> DataFrame:
        """Rows younger than the group's lifetime."""
        group = self.groups[name]
        rows = self._read(name).drop("_bucket")
        if group.ttl_seconds is None:
            return rows
        age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("_timestamp")
        return rows.where(age <= group.ttl_seconds)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rewrite the group without the keys; what stays is written out first, as the
        group is read and replaced in one go."""
        group = self.groups[name]
        stay = self._read(name).join(keys.select(*group.keys).distinct(), list(group.keys), "left_anti")
        cut_lineage(stay).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "_bucket"
        ).parquet(self._path(name))

    def info(self, name: str) -> DataFrame:
        return self._read(name).agg(
            F.count(F.lit(1)).alias("rows"), F.min("_timestamp").alias("oldest"), F.max("_timestamp").alias("newest")
        )
