"""Model data and boosted-tree scores for signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.columns import clip, ratio
from tidemark.operators.features import cross_rank
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import cut_lineage


def segments(df: DataFrame, spans: Mapping[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Name of the segment a row's date falls in; rows of none are left out."""
    name = F.coalesce(*[F.when(F.col(date).between(a, b), n) for n, (a, b) in spans.items()])
    return df.withColumn("segment", name).where(F.col("segment").isNotNull())


def robust_zscore(df: DataFrame, features: Sequence[str], fitted_on: DataFrame, limit: float = 3.0) -> DataFrame:
    """(x - median) / (1.4826 MAD), both from ``fitted_on``, held in +-limit.

    All features are measured together in long form; two passes give exact medians.
    """
    def long(frame: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features]))
        return frame.select(pairs.alias("p")).select("p.*").where(F.col("v").isNotNull())

    # the features are dear and four passes read them: they are written once
    rows = cut_lineage(long(fitted_on))
    middle = exact_quantiles(rows, ["f"], "v", {"med": 0.5})
    away = rows.join(F.broadcast(middle), "f").select("f", F.abs(F.col("v") - F.col("med")).alias("v"))
    mad = exact_quantiles(away, ["f"], "v", {"mad": 0.5})
    # one row per feature name, so the marks become constants of the projection
    marks = {r["f"]: (r["med"], r["mad"]) for r in middle.join(mad, "f").collect()}
    return df.withColumns(
        {
            f: clip(ratio(F.col(f) - F.lit(marks[f][0]), F.lit(marks[f][1]) * 1.4826), -limit, limit)
            for f in features
            if f in marks
        }
    )


def model_data(df: DataFrame, features: Sequence[str], label: str, spans: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Segments, robust features with gaps as 0, rows with a label, label ranked per date."""
    df = segments(df, spans)
    first = next(iter(spans))
    df = robust_zscore(df, features, df.where(F.col("segment") == first))
    df = df.fillna(0.0, list(features)).where(F.col(label).isNotNull())
    df = cross_rank(df, label, "label_rank", pct=True)
    return df.withColumn("label_rank", (F.col("label_rank") - 0.5) * 3.46)


def boosted_scores(data: DataFrame, features: Sequence[str], label: str = "label_rank", train: str = "train", test: str = "test", seed: int = 1) -> DataFrame:
    """Fit on the training segment, score the test segment: (date, symbol, score)."""
    vec = VectorAssembler(inputCols=list(features), outputCol="__x").transform(data)
    model = GBTRegressor(featuresCol="__x", labelCol=label, predictionCol="score", maxDepth=4, maxIter=10, stepSize=0.1, seed=seed)
    vec = cut_lineage(vec.select("date", "symbol", "segment", label, "__x"))
    fit = model.fit(vec.where(F.col("segment") == train))
    return fit.transform(vec.where(F.col("segment") == test)).select("date", "symbol", "score")
