"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled 1 outside the held-out fold; all texts are the unlabelled
web text; the class prior is estimated as the share of 1 among the labels learned from. The
model is logistic over statistics of the whole text. With the logistic loss the unbiased risk is
``prior * E_p[-z] + E_u[log(1 + exp(z))]``; Newton steps on it take all rows, one grouped sum of
gradient and curvature a step. A step is taken where it lowers the non-negative risk, whose part
for negatives, ``E_u[l(-z)] - prior * E_p[l(-z)]``, counts as 0 below 0; from such a point the
step goes back up that part's gradient.

Defined results: a null text is empty, and empty texts get a score as any other; a null id is
never held out and has no label; several labels of one id count as their least; repeated rows
are scored each; without a positive label the score is the prior (0.5 without labels) everywhere;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality_rules import text_counts
from tidemark.llm.shared import bounded_batches, written

#: Characters counted in each text, as patterns.
MARKS = {"upper": "\\p{Lu}+", "bang": "!+", "pipe": "\\|+", "sign": "[#*$%&<>@^~=_+{}\\[\\]\\\\]+", "digit": "\\p{Nd}+", "point": "[.,;:?]+"}
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def features(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with ``x``: an array of statistics of the whole text, the first of them 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in rows.columns if c != text]
    lost = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).alias
    marked = rows.select(*rest, F.col(text), F.size(F.array_distinct(F.split(F.lower(t), "[\\x20\\x09-\\x0D]+"))).alias("n_distinct"), *(lost(p)(n) for n, p in MARKS.items()))
    c = text_counts(marked, text)
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    root = lambda a, b: F.sqrt(F.col(a) / b)
    variety = F.log1p("n_distinct") / F.log(words + 2)
    x = [
        F.lit(1.0),
        *(root(n, chars) for n in MARKS),
        F.col("upper") / chars,
        F.col("n_symbols") / chars,
        (F.col("n_symbols") > 0.02 * chars).cast("double"),
        (F.col("upper") > 0.2 * chars).cast("double"),
        (F.col("pipe") > 0.02 * chars).cast("double"),
        (F.col("bang") > 0.02 * chars).cast("double"),
        root("n_repeat_words", words),
        F.col("n_repeat_words") / words,
        (F.col("n_repeat_words") > 0.1 * words).cast("double"),
        root("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))),
        variety,
        variety * variety,
        variety * F.log1p("n_words"),
        F.log1p("n_words"),
        F.pow(F.log1p("n_words") / 5, F.lit(2)),
        F.log(chars / words),
        root("n_lines", words),
    ]
    return c.select(*rest, F.array(*(v.cast("double") for v in x)).alias("x"))


def summed(rows: DataFrame, width: int, per_row) -> np.ndarray:
    """Sum over all rows of ``per_row(x, positive)``, a function from arrays to a vector, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = per_row(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "v"])

    out = np.zeros(width)
    for r in rows.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row for each place
        out[r["i"]] = r["v"]
    return out


def curvature(w: np.ndarray):
    """Sums at ``w``: rows, positives, x of positives, sigma x, sigma x of positives, sigma(1-sigma) x x'."""

    def per_row(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        return np.concatenate(([len(x), positive.sum()], x[positive].sum(0), s @ x, s[positive] @ x[positive], ((x * (s * (1 - s))[:, None]).T @ x).ravel()))

    return per_row


def risks(trials: np.ndarray):
    """Sums for each row of ``trials``: log(1+e^z) over all, over positives, z over positives."""

    def per_row(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = x @ trials.T
        soft = np.logaddexp(0, z)
        return np.concatenate((soft.sum(0), soft[positive].sum(0), z[positive].sum(0)))

    return per_row


def fit(rows: DataFrame, prior: float, steps: int = 12, ridge: float = 1e-3, least: float = 1e-5) -> np.ndarray:
    """Weights of least non-negative risk over ``rows`` (x, positive)."""
    first = rows.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 1
    w, least_w, least_risk = np.zeros(d), np.zeros(d), np.inf
    for _ in range(steps):
        total = summed(rows, 2 + 3 * d + d * d, curvature(w))
        n, p = total[0], total[1]
        if not p:
            return np.concatenate(([np.log(prior / (1 - prior))], np.zeros(d - 1)))
        x_p, s_u, s_p, h = total[2 : 2 + d] / p, total[2 + d : 2 + 2 * d] / n, total[2 + 2 * d : 2 + 3 * d] / p, total[2 + 3 * d :].reshape(d, d) / n
        move = -np.linalg.solve(h + ridge * np.eye(d), s_u - prior * x_p + ridge * w)
        back = s_u - prior * s_p  # gradient of the negatives' part
        sizes = np.array([1.0, 0.5, 0.25, 0.1, 0.02])
        trials = np.vstack((w, w + sizes[:, None] * move, w + back / max(np.linalg.norm(back), 1e-12) * 0.1))
        soft_u, soft_p, z_p = summed(rows, 3 * len(trials), risks(trials)).reshape(3, -1)
        negative = soft_u / n - prior * soft_p / p
        risk = prior * (soft_p - z_p) / p + np.maximum(negative, 0) + ridge / 2 * (trials**2).sum(1)
        best = int(risk[:-1].argmin())
        if risk[best] < least_risk:
            least_w, least_risk = trials[best], risk[best]
        if best == 0 and negative[0] < 0:
            best = len(trials) - 1
        elif risk[0] - risk[best] < least:
            break
        w = trials[best]
    return least_w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality") -> tuple[DataFrame, np.ndarray]:
    """The written features (id, x, positive) of all rows and the weights learned from them."""
    learned = labels.select(F.col(label_id).alias("l_id"), F.col(label).cast("int").alias("l")).where(F.col("l_id").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("l_id")))
    learned = written(learned.groupBy("l_id").agg(F.min("l").alias("l")), "labels")
    shares = learned.agg(F.sum("l"), F.count(F.lit(1))).first()
    # one row of each class is added, so that the prior is never 0 or 1
    prior = (float(shares[0] or 0) + 1) / (shares[1] + 2)
    seen = features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = written(seen.join(learned, seen["id"] == learned["l_id"], "left").select("id", "x", F.coalesce(F.col("l") == 1, F.lit(False)).alias("positive")), "features")
    return rows, fit(rows, prior)


def score_of(x: Column, w: np.ndarray) -> Column:
    z = F.lit(0.0)
    for i, v in enumerate(w):
        z = z + x[i] * F.lit(float(v))
    return F.round(1 / (1 + F.exp(-z)), 9)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """``id_col``, held_out, score, predicted of every row; ``labels`` has ids and 0 or 1 in ``label``."""
    rows, w = train(docs, labels, id_col, text_col, label_id, label)
    score = score_of(F.col("x"), w)
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"), (score >= cut).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``cut`` or more; texts are scored where they lie, not joined."""
    _, w = train(docs, labels, id_col, text_col, label_id, label)
    seen = features(docs.select(F.struct(*docs.columns).alias("row_"), F.col(text_col).alias("text_")), "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # scored here, as Spark would push a filter, and with it the statistics, below what they are computed from
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                on = np.round(1 / (1 + np.exp(-np.clip(x @ w, -500, 500))), 9) >= cut
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(on))], ["row_"])

    bounded_batches(docs.sparkSession)
    return seen.mapInArrow(run, seen.select("row_").schema).select("row_.*")
