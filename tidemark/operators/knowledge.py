"""Knowledge triples: queries, merges, inference, and text search.

Rows: (id, type, subject, predicate, object, confidence, source, timestamp, tags).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import NGram, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.text import similarity, triple_id
from tidemark.session import Kept, bounded_batches, cut_lineage

SPO = ("subject", "predicate", "object")


def with_ids(triples: DataFrame) -> DataFrame:
    return triples.withColumn("id", triple_id(*[F.col(c) for c in SPO]))


def exact(triples: DataFrame, tag: str | None = None, **conditions: str) -> DataFrame:
    """All conditions together; without any, nothing."""
    tests: list[Column] = [F.col(k) == v for k, v in conditions.items() if v is not None]
    if tag is not None:
        tests.append(F.array_contains("tags", tag))
    return triples.where(reduce(lambda a, b: a & b, tests) if tests else F.lit(False))


def by_words(triples: DataFrame, text: str) -> DataFrame:
    """Triples in which every word of the text occurs."""
    import re

    words = re.findall(r"\w+", text.lower())
    if not words:
        return triples.where(F.lit(False))
    tokens = F.split(F.lower(F.concat_ws(" ", *SPO)), "(?U)\\W+")
    return triples.where(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(tokens, w)))


def by_regex(triples: DataFrame, pattern: str) -> DataFrame:
    return triples.where(F.concat_ws(" ", *SPO).rlike("(?iU)" + pattern))


def ordered(triples: DataFrame, limit: int | None = None) -> DataFrame:
    """Surest first, then newest."""
    out = triples.orderBy(F.desc("confidence"), F.desc("timestamp"), "id")
    return out if limit is None else out.limit(limit)


def add(triples: DataFrame, new: DataFrame, seq: str = "timestamp") -> DataFrame:
    """Upsert by id: a group of copies shrinks to one row before it travels."""
    from tidemark.sources.store import keep_last

    return keep_last(triples.unionByName(new), ["id"], seq)


def remove(triples: DataFrame, ids: DataFrame) -> DataFrame:
    return triples.join(ids.select("id"), "id", "left_anti")


def counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("type").agg(F.count(F.lit(1)).alias("triples"))


#: What a rule derives from new facts and all facts: every derivation has a new fact in it.
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def transitive(predicate: str, factor: float = 0.9) -> Rule:
    """a p b and b p c give a p c, less sure by the factor.

    New facts are joined with all facts on the right, and with the old ones on the left, so a
    pair of facts meets once, in the round in which the later of them is new.
    """

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        first = left.select("subject", F.col("object").alias("mid"), F.col("confidence").alias("c1"))
        second = right.select(F.col("subject").alias("mid"), "object", F.col("confidence").alias("c2"))
        return first.join(second, "mid").where(F.col("subject") != F.col("object")).select(
            "subject", F.lit(predicate).alias("predicate"), "object", (F.col("c1") * F.col("c2") * factor).alias("confidence")
        )

    def rule(new: DataFrame, known: DataFrame) -> DataFrame:
        mine = F.col("predicate") == predicate
        old = known.where(mine).where(~F.col("new"))
        return meet(new.where(mine), known.where(mine)).unionByName(meet(old, new.where(mine)))

    return rule


def infer(triples: DataFrame, rules: Sequence[Rule], max_rounds: int | None = None) -> DataFrame:
    """Apply the rules until they yield nothing new; an error where ``max_rounds`` rounds are not enough.

    Semi-naive: a round derives only from what the round before it found, with all that is
    known (``new`` marks what is of the last round). A fact keeps the best confidence of the
    round that found it, and that round's number.
    """
    known = cut_lineage(triples.select(*SPO, "confidence").groupBy(*SPO).agg(F.max("confidence").alias("confidence")).withColumns({"round": F.lit(0), "new": F.lit(True)}))
    for r in count(1):
        derived = reduce(DataFrame.unionByName, [rule(known.where("new"), known) for rule in rules])
        best = derived.groupBy(*SPO).agg(F.max("confidence").alias("confidence"))
        fresh = cut_lineage(best.join(known.select(*SPO), list(SPO), "left_anti").withColumns({"round": F.lit(r), "new": F.lit(True)}))
        if fresh.isEmpty():
            return known.drop("new")
        if r == max_rounds:
            raise RuntimeError(f"facts still arrive after {max_rounds} rounds")
        known = cut_lineage(known.withColumn("new", F.lit(False)).unionByName(fresh))


def search_entities(entities: DataFrame, text: str, types: Sequence[str] | None = None, limit: int = 10, threshold: float = 0.6) -> DataFrame:
    """Names similar to the text, best first."""
    out = entities if not types else entities.where(F.col("type").isin(list(types)))
    out = out.withColumn("similarity", similarity(F.lit(text), F.col("name"))).where(F.col("similarity") >= threshold)
    return out.orderBy(F.desc("similarity"), "id").limit(limit)


#: Shares of the terms that are weighed one after the other.
SHARES = 16


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key and distinct term of rows (key, terms)."""
    for batch in batches:
        lists = batch.column(1)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        terms, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), size)
        order = np.lexsort((terms, row))
        terms, row = terms[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])))) if len(terms) else np.empty(0, int)
        tf = np.diff(np.append(first, len(terms)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(terms[first], pa.int64()), pa.array(tf, pa.int64())], ["__k", "__w", "tf"])


def semantic_search(docs: DataFrame, key: str, text: str, asked: str, limit: int = 10) -> DataFrame:
    """Cosine of TF-IDF vectors over all words and word pairs, best first.

    idf is ln((n+1)/(df+1)). Terms are compared by 64-bit hashes and counted inside the row; only
    rows whose key stands again are counted by grouping. The counts are written once. Squares
    for the lengths are summed in ``SHARES`` shares of the terms, one after the other, so the disk
    holds the counts and the shuffle of one share.
    """
    spark = docs.sparkSession
    tokens = RegexTokenizer(inputCol="__x", outputCol="__t", pattern="(?U)\\W+", toLowercase=True)
    pairs = NGram(n=2, inputCol="__t", outputCol="__p")

    def terms(df: DataFrame) -> DataFrame:
        both = pairs.transform(tokens.transform(df))
        return both.select("__k", F.transform(F.concat("__t", "__p"), lambda w: F.xxhash64(w)).alias("__w"))

    bounded_batches(spark, 4)
    # no null reaches the tokenizer, in whatever order the filters run
    stored = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__x"))
    n = stored.count()
    schema = StructType([stored.schema["__k"], StructField("__w", LongType()), StructField("tf", LongType())])
    repeated = Kept(stored.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("__k").alias("__r")), F.count(F.lit(1)).alias("n"))
    once = stored
    if repeated.told["n"]:
        again = F.col("__k").eqNullSafe(F.col("__r"))
        once = stored.join(repeated.rows, again, "left_anti")
    counts = terms(once).mapInArrow(_counted_terms, schema)
    if repeated.told["n"]:
        more = terms(stored.join(repeated.rows, again, "left_semi")).select("__k", F.explode("__w").alias("__w"))
        counts = counts.unionByName(more.groupBy("__k", "__w").agg(F.count(F.lit(1)).alias("tf")))
    counted = Kept(counts, F.count(F.lit(1)).alias("n"), codec="zstd").rows
    repeated.drop()

    def idf(df: str) -> Column:
        return F.log(F.lit(n + 1.0) / (F.col(df) + 1))

    # a row for each term asked for
    query = terms(spark.createDataFrame([(0, asked)], "__k int, __x string")).select(F.explode("__w").alias("__w")).groupBy("__w").agg(F.count(F.lit(1)).alias("times"))
    met = counted.join(F.broadcast(query), "__w").groupBy("__w", "times").agg(F.count(F.lit(1)).alias("df"))
    wanted = cut_lineage(met.select("__w", idf("df").alias("idf"), (F.col("times") * idf("df")).alias("q")))
    size = wanted.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("size")).first()["size"] or 0.0
    if not size:
        return docs.select(key, F.lit(0.0).alias("similarity")).limit(0)
    dots = counted.join(F.broadcast(wanted), "__w").groupBy("__k").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"))

    def squares(share: int) -> DataFrame:
        mine = counted.where(F.pmod("__w", F.lit(SHARES)) == share)
        weighed = mine.join(mine.groupBy("__w").agg(F.count(F.lit(1)).alias("df")), "__w").withColumn("v", F.col("tf") * idf("df"))
        return Kept(weighed.groupBy("__k").agg(F.sum(F.col("v") * F.col("v")).alias("square")), F.count(F.lit(1)).alias("n")).rows

    every = reduce(DataFrame.unionByName, [squares(share) for share in range(SHARES)])
    found = dots.unionByName(every, allowMissingColumns=True).groupBy("__k").agg(F.sum("dot").alias("dot"), F.sqrt(F.sum("square")).alias("length"))
    out = found.where((F.col("dot") > 0) & (F.col("length") > 0)).select(F.col("__k").alias(key), (F.col("dot") / F.col("length") / F.lit(size)).alias("similarity"))
    return out.orderBy(F.desc("similarity"), key).limit(limit)
