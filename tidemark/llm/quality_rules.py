"""Quality rules: counts of each text, then robust multivariate outliers for each language and source.

The counts are Column work inside the row. The outlier rule fits a minimum covariance
determinant on transformed statistics of each (lang, source): from three starts, rows are
concentrated on the ``share`` nearest by Mahalanobis distance, the start of least determinant
is concentrated further, and the estimate is reweighted once. A concentration step is two
grouped sums: a histogram of distances for each group, whose bins are bounded, and moments of
the rows below the bin that holds the wanted rank (rows of that bin included). So a group may
hold any share of all rows; no group is ordered or collected. A ridge keeps estimates regular
where a statistic is constant (no symbols at all in most texts).

Defined results: a null text has no words and fails the base rule, as an empty one does; null
lang or source is a group of its own; groups under ``least`` rows share one estimate, and where
that pool is too small, too, nothing is rejected by distance; repeated rows count and are
judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Spread below which differences of a statistic do not count: log words, log word length, and
#: the square roots of the shares of symbols, repeated lines and repeated words. Where a group's
#: core holds none, the default cut (5.07 spreads) is met by 2.3 % of symbols or by half of the
#: lines repeated; more than a fifth of repeated words fails the base rule before.
RIDGE = (0.5, 0.15, 0.03, 0.14, 0.15)
DIM = len(RIDGE)
X = [f"x{i}" for i in range(DIM)]
#: Bins of a distance: this many to a doubling.
BINS = 32
#: Estimates of so many groups at most (some hundred bytes each) are broadcast.
FEW_GROUPS = 20_000
#: Tasks over which a group is dealt where they are not.
SALTS = 64


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def chi_square_quantile(p: float, df: int = DIM) -> float:
    """Wilson and Hilferty's cube."""
    a = 2 / (9 * df)
    return df * (1 - a + normal_quantile(p) * math.sqrt(a)) ** 3


def text_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in rows.columns if c != text]
    split = rows.select(*rest, t.alias("t_"), F.array_remove(F.split(t, BLANKS), "").alias("w_"), F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l_"))
    w = F.col("w_")
    grams = F.when(F.size(w) > 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(w[i + k] for k in range(5)))))
    counted = split.select(
        *rest,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("t_") - F.length(F.regexp_replace("t_", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("l_").cast("long").alias("n_lines"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        grams.alias("g_"),
    )
    return counted.select(*(c for c in counted.columns if c != "g_"), repeated_words(F.col("g_")).alias("n_repeat_words"))


def repeated_words(grams: Column, k: int = 5) -> Column:
    """Words inside windows of ``k`` words that stand twice or more; ``grams`` are the windows' hashes in order.

    Only a text with an equal pair is sorted: equal hashes then stand side by side, and the
    places of those with an equal neighbour, in order, cover ``min(k, gap)`` words each.
    """
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(grams) - 1

    def places(s: Column) -> Column:
        twice = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))
        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

    # transform over a one-element array names a value, so that it is computed once
    at = F.transform(F.array(ordered), places)[0]
    cover = lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, F.lit(k)).otherwise(F.least(F.lit(k), x - p[F.greatest(i - 1, F.lit(0))]))), F.lit(0), lambda a, b: a + b)
    covered = F.transform(F.array(at), cover)[0]
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(0).cast("long")


def statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with the transformed statistics x0.. of texts that have a word."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = (
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    )
    return rows.select("*", *(v.alias(x) for v, x in zip(values, X, strict=True)))


def factored(params: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n, means m0.., the lower Cholesky factor l00.. and log_det from n, m.. and covariances c00.. ."""
    out = params
    for j in range(DIM):
        for i in range(j, DIM):
            rest = F.col(f"c{i}{j}") + (RIDGE[j] ** 2 if i == j else 0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = reduce(lambda a, b: a + b, (2 * F.log(f"l{j}{j}") for j in range(DIM)))
    return out.select(*keys, "n", *(f"m{i}" for i in range(DIM)), *(f"l{i}{j}" for i in range(DIM) for j in range(i + 1)), log_det.alias("log_det"))


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n, means and covariances of the statistics."""
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(X)), *(F.avg(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in pairs))
    return sums.select(*keys, "n", *(f"m{i}" for i in range(DIM)), *((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in pairs))


def met(rows: DataFrame, small: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` joined with what their group has in ``small``: broadcast for ``few`` groups; else every group is dealt over ``SALTS`` tasks."""
    if few:
        return rows.join(F.broadcast(small), keys, how)
    copies = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.hash(*X), F.lit(SALTS))).join(copies, [*keys, "salt_"], how).drop("salt_")


def with_distance(rows: DataFrame, params: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with their squared Mahalanobis distance ``d2`` under the estimate of their keys."""
    names = [c for c in params.columns if c not in keys]
    out = met(rows, params, keys, few, how)
    for i in range(DIM):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)))
    return out.withColumn("d2", total).drop(*names, *(f"z{i}" for i in range(DIM)))


def bin_of(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BINS).cast("int")


def rank_bins(measured: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The bin of ``d2`` that holds the row of rank ``share`` of each group: bins are counted, not rows ordered."""
    from pyspark.sql import Window

    bins = measured.groupBy(*keys, bin_of(F.col("d2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    seen = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return seen.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("most"))


def concentrated(rows: DataFrame, params: DataFrame, keys: list[str], share: float, few: bool) -> DataFrame:
    """One concentration step."""
    measured = with_distance(rows, params, keys, few)
    near = met(measured, rank_bins(measured, keys, share), keys, few).where(bin_of(F.col("d2")) <= F.col("most"))
    return written(factored(moments(near, keys), keys), "mcd")


def starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from: quartiles, plain moments, and the moments of an eighth of the rows."""
    plain = moments(rows, ["g"])
    eighth = moments(rows.where(F.pmod(F.xxhash64(*X), F.lit(8)) == 3), ["g"])
    q = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in X))
    spread = lambda i: F.pow((F.col(X[i])[2] - F.col(X[i])[0]) / 1.349, F.lit(2))
    quartiles = q.select("g", "n", *(F.col(x)[1].alias(f"m{i}") for i, x in enumerate(X)), *((spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)))
    named = [p.withColumn("start", F.lit(s)) for s, p in enumerate((quartiles, plain, eighth))]
    return written(factored(reduce(DataFrame.unionByName, named), ["g", "start"]), "starts")


def robust_estimates(rows: DataFrame, few: bool, share: float = 0.75, first: int = 2, more: int = 3) -> DataFrame:
    """g, means, factor and ``scale`` of the reweighted minimum-covariance-determinant estimate of each group.

    ``scale`` brings the median distance to that of the normal model, so that one cut fits all groups.
    """
    each = rows.select("g", *X)
    tried = starts(each)
    copies = each.withColumn("start", F.explode(F.array(*map(F.lit, range(3)))))
    for _ in range(first):
        tried = concentrated(copies, tried, ["g", "start"], share, few)
    best = tried.groupBy("g").agg(F.min_by(F.struct(*(c for c in tried.columns if c != "g")), F.struct("log_det", "start")).alias("b")).select("g", "b.*").drop("start")
    for _ in range(more):
        best = concentrated(each, best, ["g"], share, few)

    def scaled(params: DataFrame) -> DataFrame:
        middle = rank_bins(with_distance(each, params, ["g"], few), ["g"], 0.5)
        return params.join(middle.select("g", (chi_square_quantile(0.5) / F.pow(F.lit(2.0), (F.col("most") + 0.5) / BINS)).alias("scale")), "g")

    rough = written(scaled(best), "rough")
    measured = met(with_distance(each, rough.drop("scale"), ["g"], few), rough.select("g", "scale"), ["g"], few)
    near = measured.where(F.col("d2") * F.least(F.col("scale"), F.lit(1.0)) <= chi_square_quantile(0.975))
    return written(scaled(written(factored(moments(near, ["g"]), ["g"]), "reweighted")), "robust")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = 0.9999, least: int = 50) -> DataFrame:
    """``id_col``, counts, base_failed, kept and the scaled distance of every row.

    Kept are rows that pass the base rule and lie inside the ``cut`` quantile of their group's
    model, whose scale is never taken smaller than the ridge.
    """
    group = F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s")), {"ignoreNullFields": "false"})
    rows = docs.select(F.col(id_col).alias("id"), group.alias("own"), F.col(text_col).alias("text"))
    counted = written(statistics(text_counts(rows)), "counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    spoken = counted.where("n_words > 0")
    sizes = spoken.groupBy("own").agg(F.count(F.lit(1)).alias("rows")).select("own", F.when(F.col("rows") >= least, F.col("own")).otherwise("pool").alias("g"))
    sizes = written(sizes, "groups")
    few = sizes.count() <= FEW_GROUPS
    params = robust_estimates(met(spoken, sizes, ["own"], few), few)
    by_group = sizes.join(params, "g", "left").drop("g")
    out = with_distance(counted, by_group.drop("scale", "n"), ["own"], few, "left")
    out = met(out, by_group.select("own", "scale", F.col("n").alias("n_fit")), ["own"], few, "left")
    distance = F.when(F.col("n_fit") >= least // 2, F.col("d2") * F.least(F.col("scale"), F.lit(1.0)))
    kept = ~failed & F.coalesce(distance <= chi_square_quantile(cut), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), distance.alias("distance"))
