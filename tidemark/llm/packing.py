"""Packing into optimal length buckets with token-budget batches.

Texts longer than ``longest`` tokens are cut into pieces of that length and a rest. One global
histogram of piece lengths, at most ``longest`` rows, goes to the driver, where dynamic
programming chooses the bucket boundaries of least padding. Inside a bucket, pieces get dense
positions in a hashed order, and positions are cut into batches of ``budget`` padded tokens.

Positions do not order a bucket in one task: pieces are dealt by hash into cells of bounded
share, ordered inside each cell, and shifted by the counts of the cells before.

Defined results: a text without tokens (null or empty) has one row with length 0 and no bucket,
batch or slot; repeated rows are packed each; rows with a null id are dealt by their place in
the table; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding over the histogram.

    ``cost[i, j]`` is the padding of lengths i..j-1 under the bound ``lengths[j-1]``; the last
    bound is the greatest length. O(buckets * n**2) in numpy for n distinct lengths.
    """
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(x)
    if m == 0:
        return []
    held = np.concatenate(([0], np.cumsum(n)))
    tokens = np.concatenate(([0], np.cumsum(n * x)))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = np.zeros((min(buckets, m) + 1, m + 1), np.int64)
    for k in range(1, min(buckets, m) + 1):
        now = np.full(m + 1, np.iinfo(np.int64).max // 4)
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (held[j] - held[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            now[j], back[k, j] = cost[i], i
        best = now
        if best[m] == 0:
            break
    out, j = [], m
    while j:
        out.append(int(x[j - 1]))
        j, k = int(back[k, j]), k - 1
    return out[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", longest: int = 2048, buckets: int = 8, budget: int = 65536, seed: int = 7) -> DataFrame:
    """``id_col``, piece, start, length, upper, batch, slot of every piece of every row.

    (upper, batch) names a batch of ``budget // upper`` slots; only the last batch of a bucket is
    not full.
    """
    size = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    rows = lengths.select(F.col(id_col).alias("id"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("size") / longest), F.lit(1)) - 1
    pieces = rows.select("id", "size", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * longest
    hashed = F.when(F.col("id").isNull(), F.xxhash64("row", "piece", F.lit(seed))).otherwise(F.xxhash64("id", "piece", F.lit(seed)))
    pieces = written(pieces.select("id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(longest)).alias("length"), hashed.alias("h")), "pieces")

    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().where("length > 0").collect()}
    bounds = boundaries(list(histogram), list(histogram.values()), buckets)
    of = {b: sum(n for x, n in histogram.items() if (bounds[i - 1] if i else 0) < x <= b) for i, b in enumerate(bounds)}
    per_cell = max(512, math.ceil(sum(of.values()) / 20_000))
    upper = F.lit(None).cast("long")
    cells = F.lit(1).cast("long")
    for b in reversed(bounds):
        fits = (F.col("length") <= b) & (F.col("length") > 0)
        upper, cells = F.when(fits, F.lit(b)).otherwise(upper), F.when(fits, F.lit(math.ceil(of[b] / per_cell))).otherwise(cells)
    dealt = pieces.withColumn("upper", upper.cast("long")).withColumn("cell", F.pmod(F.xxhash64("h"), cells))
    placed = dealt.where("upper is not null")

    counts = placed.groupBy("upper", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("upper", "cell", (F.sum("n").over(Window.partitionBy("upper").orderBy("cell")) - F.col("n")).alias("before"))
    inside = placed.withColumn("at", F.row_number().over(Window.partitionBy("upper", "cell").orderBy("h", "id", "piece", "length")) - 1)
    positions = inside.join(before, ["upper", "cell"]).withColumn("at", F.col("at") + F.col("before"))
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("upper")), F.lit(1))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "upper"]
    packed = positions.select(*columns, F.floor(F.col("at") / per_batch).alias("batch"), F.pmod("at", per_batch).alias("slot"))
    none = F.lit(None).cast("long")
    return packed.unionByName(dealt.where("upper is null").select(*columns, none.alias("batch"), none.alias("slot")))
