"""Filter interaction audit: what every order of five filters keeps and removes, from counts by failure mask.

One pass turns a text into the mask of filters it fails and a SHA-256 digest. For the duplicate
filter, every task counts digests into a counting Bloom sketch, of which only the touched cells
travel; partial sketches are added up block by block, and cells met once clear the texts that
set them as unique. A second pass hands on the texts that may repeat, and only those: grouped by
the full text they give the least id of each repeated text. Masks of repeats are then moved from
"passes" to "fails" in the counts: all rows of repeated texts less those that hold the least id,
both grouped before they are joined, so a text with a third of all rows is a few rows a task.
Every order and step follows from the counts of the 2**k masks of a part.

The merged sketch is sent to all tasks: two bytes a text, up to 128 MB (``sketch.MOST_BLOCKS``).
With more texts than that more of them are shuffled as possible repeats; the result is exact at
any load.

Defined results: a null text is an empty one (two of them are equal); a null part is the empty
string; a row without id is no duplicate and has no label, and no row is a duplicate of it; rows
that repeat id and text are not duplicates of each other; a document is good or toxic if any of
its label rows says so; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, written
from tidemark.llm.sketch import Sketch

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass
class TextStatistics:
    """Arrays over the texts of a batch."""

    words: np.ndarray
    distinct: np.ndarray
    upper: np.ndarray
    points: np.ndarray
    marked: np.ndarray


#: Failure conditions by letter; the duplicate filter is not among them.
FILTERS: dict[str, Callable[[TextStatistics], np.ndarray]] = {
    "A": lambda s: s.words < 200,
    "B": lambda s: 100 * s.distinct < 50 * s.words,
    "C": lambda s: 100 * s.upper > 2 * s.points,
    "D": lambda s: s.marked,
}
DUPLICATE = "E"


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; of a null text none."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def text_statistics(texts: list[bytes]) -> TextStatistics:
    # bytes.split() cuts at blank and tab to carriage return, and nowhere else
    counted = [(len(w), len(set(w))) for w in (t.split() for t in texts)]
    lost = lambda chars: np.array([len(t) - len(t.translate(None, chars)) for t in texts], np.int64)
    words, distinct = np.array(counted, np.int64).reshape(-1, 2).T
    sizes = np.array([len(t) for t in texts], np.int64)
    return TextStatistics(words, distinct, lost(_UPPER), sizes - lost(_CONTINUED), lost(_MARKS) > 0)


def digests(texts: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(t).digest() for t in texts]


def text_masks(docs: DataFrame, filters: dict[str, Callable], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask (bit i: fails the i-th filter), digest of every row."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    schema = read.select("id", "part", F.lit(0).alias("mask"), F.lit(b"").alias("digest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(2))
            found = text_statistics(texts)
            mask = np.zeros(len(texts), np.int32)
            for bit, fails in enumerate(filters.values()):
                mask |= fails(found).astype(np.int32) << bit
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask), pa.array(digests(texts), pa.binary())], schema.names)

    return read.mapInArrow(run, schema)


def digest_words(held: list[bytes]) -> np.ndarray:
    """The two words of the sketch that a digest gives."""
    return np.frombuffer(b"".join(held), "<u8").reshape(-1, 4)[:, :2]


# --- possible and exact repeats


def possible_rows(rows: DataFrame, sketch: Sketch) -> DataFrame:
    """The rows (with digest) whose text may repeat."""
    at = rows.columns.index("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sketch.met(digest_words(batch.column(at).to_pylist()))))

    return rows.mapInArrow(run, rows.schema)


def repeated_texts(docs: DataFrame, sketch: Sketch, id_col: str, text_col: str) -> DataFrame:
    """digest, first: the least id of every text that stands in several rows, grouped by the full text."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = read.select("id", "text", F.lit(b"").alias("digest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = digests(raw_texts(batch.column(1)))
            on = pa.array(sketch.met(digest_words(held)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], schema.names).filter(on)

    grouped = read.mapInArrow(run, schema).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return grouped.where("n > 1 and first is not null").select("digest", "first")


# --- counts by mask, orders and steps

SUMS = ("n", "good", "toxic")


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic; the duplicate filter is the bit after those of ``filters``."""
    filters = filters or FILTERS
    duplicate = 1 << len(filters)
    bounded_batches(docs.sparkSession)
    facts = written(text_masks(docs, filters, id_col, text_col, part_col), "facts")
    told = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null")
    told = told.groupBy("id").agg(*(F.max(F.coalesce(c, F.lit(False))).cast("long").alias(c) for c in ("good", "toxic"))).where("good + toxic > 0")
    none = F.lit(0).cast("long")
    labelled = written(facts.join(told, "id").select("id", "part", "mask", "digest", none.alias("n"), "good", "toxic"), "labelled")
    rows = facts.select("id", "part", "mask", "digest", F.lit(1).cast("long").alias("n"), none.alias("good"), none.alias("toxic")).unionByName(labelled)

    sketch = Sketch(facts.select("digest"), lambda batch: digest_words(batch.column(0).to_pylist()), facts.count(), 2)
    repeats = written(repeated_texts(docs, sketch, id_col, text_col), "repeats")
    seen = written(summed(possible_rows(rows.where("id is not null"), sketch), "digest", "part", "mask", "id"), "possible")
    of_repeats = summed(summed(seen, "digest", "part", "mask").join(repeats, "digest"), "part", "mask")
    firsts = summed(seen.join(repeats.withColumnRenamed("first", "id"), ["digest", "id"]), "part", "mask")

    def moved(counts: DataFrame, sign: int, mask: Column) -> DataFrame:
        return counts.select("part", mask.alias("mask"), *((sign * F.col(c)).alias(c) for c in SUMS))

    clear, fails = F.col("mask"), F.col("mask").bitwiseOR(F.lit(duplicate))
    every = summed(rows, "part", "mask")
    for counts, sign in ((of_repeats, 1), (firsts, -1)):
        every = every.unionByName(moved(counts, sign, fails)).unionByName(moved(counts, -sign, clear))
    return summed(every, "part", "mask")


def order_effects(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of ``letters`` and step from ``counts`` (part, mask, n, good, toxic)."""
    k = len(letters)
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "bit": 1 << letters.index(order[i]), "before": sum(1 << letters.index(x) for x in order[:i])}
        for order in permutations(letters)
        for i in range(k)
    ]
    # one literal to Spark, however many steps there are
    constant = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    each = counts.select("part", "mask", *SUMS, F.explode(constant).alias("at")).select("part", "mask", *SUMS, "at.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda holds, value: F.sum(F.when(holds, value).otherwise(0))
    # of the orders, a filter removes a mask of s filters in one of s
    share = F.col("n") * F.expr(f"{factorial(k)} div greatest(bit_count(mask), 1)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, F.col("n")).alias("kept"),
        total(fails & ~earlier, F.col("n")).alias("removed"),
        total(fails & earlier, F.col("n")).alias("redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(fails & ~earlier, F.col("good")).alias("good_lost"),
        total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` maps a letter to a failure condition over :class:`TextStatistics` (default
    ``FILTERS``); the duplicate filter ``E`` is added. Every order of the letters is told.
    """
    filters = filters or FILTERS
    return order_effects(mask_counts(docs, labels, filters, id_col, text_col, part_col), "".join(filters) + DUPLICATE)


def audit_filters_sql() -> str:
    return r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), told AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
  SELECT doc_id, part,
    (len(ws) < 200)::INT
    + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask
  FROM words
), counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) AS r(step)
), told_steps AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told_steps
"""
