"""Lexicon sentiment, emotions, and their trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import clip
from tidemark.functions import lexicons as lx
from tidemark.session import bounded_batches

TOKENS = "(?U)[\\u4e00-\\u9fff]+|[a-zA-Z]+|\\d+"
LABELS = ("very_negative", "negative", "neutral", "positive", "very_positive")


class Lexicon:
    """Word scores, degrees and negations; a plain word list beats the weighted one."""

    def __init__(
        self,
        positive: Sequence[str] = lx.POSITIVE,
        negative: Sequence[str] = lx.NEGATIVE,
        neutral: Sequence[str] = lx.NEUTRAL,
        weighted: Mapping[str, float] = lx.FINANCIAL,
        degrees: Mapping[str, float] = lx.DEGREES,
        negations: Sequence[str] = lx.NEGATIONS,
        numbers: Sequence[tuple[str, float]] = lx.NUMBER_PATTERNS,
    ) -> None:
        scores: dict[str, float] = dict(weighted)
        scores |= {w: 0.0 for w in neutral}
        scores |= {w: -1.0 for w in negative}
        scores |= {w: 1.0 for w in positive}
        self.scores = {w: s for w, s in scores.items() if s != 0.0}
        self.degrees, self.negations, self.numbers = dict(degrees), list(negations), list(numbers)

    def modifier(self, before: Column, before2: Column) -> Column:
        """Degree of the word before, turned round by a negation one or two words back."""
        degree = F.lit(1.0)
        if self.degrees:
            table = F.create_map(*[F.lit(x) for kv in self.degrees.items() for x in kv])
            degree = F.coalesce(F.try_element_at(table, before), F.lit(1.0))
        negated = before.isin(self.negations) | (~before.isin(self.negations) & before2.isin(self.negations))
        return degree * F.when(negated, -1.0).otherwise(1.0)

    def number_parts(self, text: Column) -> Column:
        """Array of the scores of number patterns: x2 above 10, x1.5 above 5."""
        parts = [
            F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1)), _by_size(weight))
            for pattern, weight in self.numbers
        ]
        return F.concat(*parts) if parts else F.expr("cast(array() as array<double>)")


def _by_size(weight: float):
    return lambda v: F.lit(weight) * F.when(v.cast("double") > 10, 2.0).when(v.cast("double") > 5, 1.5).otherwise(1.0)


def label(score: Column) -> Column:
    return (
        F.when(score >= 0.6, "very_positive")
        .when(score >= 0.2, "positive")
        .when(score <= -0.6, "very_negative")
        .when(score <= -0.2, "negative")
        .otherwise("neutral")
    )


def _result(df: DataFrame, total: Column, count: Column) -> DataFrame:
    df = df.withColumn("score", F.when(count > 0, clip(total / count, -1, 1)).otherwise(0.0))
    return df.withColumns(
        {
            "label": label(F.col("score")),
            "confidence": F.when(count > 0, F.least(F.abs("score") + 0.3, F.lit(1.0))).otherwise(0.3),
        }
    )


def lexicon_sentiment(docs: DataFrame, key: str, text: str = "text", lexicon: Lexicon | None = None, anywhere: bool = False) -> DataFrame:
    """Score, label and confidence per document.

    Tokens are runs of CJK, of letters, or of digits. They are matched inside the row with the
    two tokens before them: nothing is exploded and no text is shuffled.

    With ``anywhere`` lexicon words count at every position of the text, for scripts
    without spaces, where a run is not a word.
    """
    lexicon = lexicon or Lexicon()
    t = F.col(text)
    if anywhere:
        return _anywhere(docs, key, t, lexicon)
    tokens = F.regexp_extract_all(t, F.lit(TOKENS), F.lit(0))
    seen = docs.select(key, tokens.alias("__t"), lexicon.number_parts(t).alias("__k"))
    words = F.create_map(*[F.lit(x) for kv in lexicon.scores.items() for x in kv])

    def part(w, i):
        before = lambda n: F.when(i >= n, F.get(F.col("__t"), i - n)).otherwise("")
        return F.when(w.isin(list(lexicon.scores)), F.try_element_at(words, w) * lexicon.modifier(before(1), before(2)))

    hits = F.filter(F.transform("__t", part), lambda x: x.isNotNull())
    df = seen.select(key, F.concat(hits, "__k").alias("__p"))
    return _result(df, F.aggregate("__p", F.lit(0.0), lambda a, x: a + x), F.size("__p")).select(key, "score", "label", "confidence")


def _hits(text: str, longest_first: Sequence[str], scores: Mapping[str, float], degrees: Sequence[tuple[str, float]], negations: Sequence[str]) -> list[float]:
    """The scores of the lexicon words in the text by place, at each the longest; the longest degree ends there."""
    words: dict[int, str] = {}
    for word in longest_first:
        at = text.find(word)
        while at >= 0:
            words.setdefault(at, word)
            at = text.find(word, at + 1)
    out = []
    for at in sorted(words):
        before = text[max(at - 2, 0) : at]
        degree = next((x for d, x in degrees if text.endswith(d, 0, at)), 1.0)
        out.append(scores[words[at]] * degree * (-1.0 if any(n in before for n in negations) else 1.0))
    return out


def _anywhere(docs: DataFrame, key: str, t: Column, lexicon: Lexicon) -> DataFrame:
    bounded_batches(docs.sparkSession, 4)
    scores = {w: float(s) for w, s in lexicon.scores.items()}
    longest_first = sorted(scores, key=lambda w: (-len(w), w))
    # of equally long degrees the one listed last counts
    degrees = [(d, float(x)) for d, x in sorted(lexicon.degrees.items(), key=lambda dx: len(dx[0]))][::-1]
    negations = list(lexicon.negations)

    @F.arrow_udf("array<double>")
    def hits(texts: pa.Array) -> pa.Array:
        found = (None if (x := text.as_py()) is None else _hits(x, longest_first, scores, degrees, negations) for text in texts)
        return pa.array(list(found), pa.list_(pa.float64()))

    df = docs.select(key, F.concat(hits(t), lexicon.number_parts(t)).alias("__p"))
    return _result(df, F.aggregate("__p", F.lit(0.0), lambda a, x: a + x), F.size("__p")).select(key, "score", "label", "confidence")


def combine(results: Sequence[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Several methods per document: mean weighted by weight times confidence."""
    parts = [r.select(key, F.col("score") * F.col("confidence") * w, F.col("confidence") * w, "confidence") for r, w in results]
    rows = parts[0].toDF(key, "__s", "__w", "__c")
    for p in parts[1:]:
        rows = rows.unionByName(p.toDF(key, "__s", "__w", "__c"))
    out = rows.groupBy(key).agg(F.sum("__s").alias("__s"), F.sum("__w").alias("__w"), F.avg("__c").alias("confidence"))
    out = out.withColumn("score", F.when(F.col("__w") > 0, F.col("__s") / F.col("__w")).otherwise(0.0))
    return out.select(key, "score", label(F.col("score")).alias("label"), "confidence")


def adjust_strong(scored: DataFrame, text: str, signals: Sequence[tuple[str, int]] = lx.STRONG_SIGNALS) -> DataFrame:
    """The first strong signal in the text lifts the score to .8 or drops it to -.8."""
    t, s = F.col(text), F.col("score")
    side = F.lit(0)
    for word, sign in reversed(list(signals)):
        side = F.when(t.contains(word), sign).otherwise(side)
    score = F.when(side > 0, F.greatest(s, F.lit(0.8))).when(side < 0, F.least(s, F.lit(-0.8))).otherwise(s)
    df = scored.withColumns({"__side": side, "__new": score})
    return df.withColumns(
        {
            "label": F.when((F.col("__side") > 0) & (F.col("__new") > 0.8), "very_positive")
            .when((F.col("__side") < 0) & (F.col("__new") < -0.8), "very_negative")
            .otherwise(F.col("label")),
            "confidence": F.when(F.col("__side") != 0, F.least(F.col("confidence") + 0.2, F.lit(1.0))).otherwise(F.col("confidence")),
            "score": F.col("__new"),
        }
    ).drop("__side", "__new")


def emotions(docs: DataFrame, key: str, text: str = "text", words: Mapping[str, Sequence[str]] = lx.EMOTIONS) -> DataFrame:
    """Share of each emotion among the words that occur, the main one and its share."""
    t = F.col(text)
    counts = {e: sum((F.when(t.contains(w), 1.0).otherwise(0.0) for w in ws), F.lit(0.0)) for e, ws in words.items()}
    df = docs.select(key, *[c.alias(f"__{e}") for e, c in counts.items()])
    whole = sum((F.col(f"__{e}") for e in words), F.lit(0.0))
    df = df.withColumns({e: F.when(whole > 0, F.col(f"__{e}") / whole).otherwise(0.0) for e in words})
    top = F.greatest(*[F.col(e) for e in words])
    return df.select(
        key, *words, F.coalesce(*[F.when(F.col(e) == top, e) for e in words]).alias("dominant"), top.alias("intensity")
    )


def distribution(results: DataFrame) -> DataFrame:
    """Share of every label, those without a document included."""
    labels = results.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counts = results.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    # five labels at most: their counts also give the total
    out = labels.join(counts, "label", "left").select("label", F.coalesce("__n", F.lit(0)).alias("documents"))
    return out.withColumn("share", F.col("documents") / F.sum("documents").over(Window.partitionBy()))


def trend(series: DataFrame, keys: Sequence[str], order: str, window: int = 7) -> DataFrame:
    """Moving average of a bounded score series and its way from first to last."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = series.withColumn("__m", F.avg("score").over(w.rowsBetween(-(window - 1), 0)))
    out = df.groupBy(*keys).agg(
        (F.max_by("__m", order) - F.min_by("__m", order)).alias("trend"),
        F.max_by("score", order).alias("latest_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("avg_score"),
    )
    return out.withColumn(
        "direction", F.when(F.col("trend") > 0.1, "positive").when(F.col("trend") < -0.1, "negative").otherwise("stable")
    )
