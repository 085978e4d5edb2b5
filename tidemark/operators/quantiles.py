"""Exact linear percentiles that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 64
SHARES = 64


def beside_keys(rows: DataFrame, marks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with the one row of ``marks`` for their keys, a hot key dealt out by its values.

    Each row of ``marks`` goes to every share, so a task reads a share of a key and not the key.
    """
    share = F.pmod(F.xxhash64(value), F.lit(SHARES)).cast("int")
    copies = marks.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("__share", share).join(copies, [*keys, "__share"]).drop("__share")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Percentiles (linear, as numpy's default) of ``value`` per key, exactly.

    A bounded sketch proposes split points per key. Equal values are counted together,
    the counts per split say which splits hold the wanted ranks, and only the values of
    those splits are put in order: some sixty-fourth of a group, however hot it is, and
    a value that fills half the group is one row.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    counted = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # split by distinct values, as those are what a window later puts in order
    marks = counted.groupBy(*keys).agg(
        F.percentile_approx("__v", [i / SPLITS for i in range(1, SPLITS)], F.lit(1000)).alias("__s")
    )
    placed = beside_keys(counted, marks, keys, "__v").select(
        *keys, "__v", "__c", F.size(F.filter("__s", lambda s: s < F.col("__v"))).alias("__b")
    )
    # At most 64 rows per key from here on.
    sizes = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__m"))
    inside = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns(
        {
            "__from": F.coalesce(F.sum("__m").over(inside), F.lit(0)),
            "__n": F.sum("__m").over(Window.partitionBy(*keys)),
        }
    )
    ranks = {name: F.lit(float(p)) * (F.col("__n") - 1) for name, p in probs.items()}
    wanted = reduce(
        lambda a, b: a | b,
        [
            (r >= F.col("__from")) & (r < F.col("__from") + F.col("__m"))
            for h in ranks.values()
            for r in (F.floor(h), F.ceil(h))
        ],
    )
    held = placed.join(sizes.where(wanted).select(*keys, "__b", "__from", "__n"), [*keys, "__b"])
    upto = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__end", F.col("__from") + F.sum("__c").over(upto))
    start = F.col("__end") - F.col("__c")

    def at(rank):
        return F.max(F.when((rank >= start) & (rank < F.col("__end")), F.col("__v")))

    picks = []
    for name, h in ranks.items():
        picks += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}")]
    out = held.groupBy(*keys, "__n").agg(*picks)
    for name, h in ranks.items():
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out = out.withColumn(name, low + (high - low) * (h - F.floor(h)))
    return out.select(*keys, *probs)
