"""Entity mentions with spans.

Texts go to Arrow functions in batches; each is walked once by every compiled pattern and word,
and overlapping spans merge in one sorted pass, so a text costs in proportion to its length and
its matches. Patterns follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.columns import unnest
from tidemark.functions import lexicons as lx
from tidemark.functions.text import clean_text
from tidemark.session import bounded_batches

FIELDS = ("start", "end", "ord", "text", "type", "confidence")
MENTIONS = "array<struct<start:int,end:int,ord:int,text:string,type:string,confidence:double>>"
KIND = pa.list_(pa.struct(list(zip(FIELDS, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True))))


def _places(text: str, word: str) -> list[int]:
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + 1)
    return out


def word_starts(text: Column, words: Sequence[str]) -> Column:
    """Every position at which one of the words begins, overlapping ones included, in order."""
    wanted = list(dict.fromkeys(words))

    @F.arrow_udf("array<int>")
    def starts(texts: pa.Array) -> pa.Array:
        found = (t if t is None else sorted({i for w in wanted for i in _places(t, w)}) for t in texts.to_pylist())
        return pa.array(list(found), pa.list_(pa.int32()))

    return starts(text)


def _found(text: str, patterns: Mapping[str, Sequence[re.Pattern]], words: Mapping[str, Sequence[str]]) -> list[tuple]:
    """(start, end, ord, text, type, confidence) of every match and of every place of a word, in reading order."""
    out = []
    for order, (kind, regex) in enumerate((k, r) for k, regexes in patterns.items() for r in regexes):
        out += [(m.start(), m.end(), order, m[0], kind, 0.8) for m in regex.finditer(text)]
    for order, (kind, group) in enumerate(words.items(), 1000):
        for word in group:
            out += [(at, at + len(word), order, word, kind, 0.9) for at in _places(text, word)]
    return sorted(out)


def _merged(mentions: list[tuple]) -> list[tuple]:
    """Of overlapping spans keep the surer, then the longer one, in reading order."""
    out: list[tuple] = []
    for m in mentions:
        if out and m[0] < out[-1][1] and m[1] > out[-1][0]:
            if (m[5], len(m[3])) > (out[-1][5], len(out[-1][3])):
                out[-1] = m
        else:
            out.append(m)
    return out


def _lists(rows: list[tuple], ends: list[int | None]) -> pa.Array:
    """The mentions of all texts, one behind the other, as a list for each text; null where a text has no end."""
    kinds = KIND.value_type
    flat = zip(*rows, strict=True) if rows else ((),) * len(FIELDS)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kinds, strict=True)], fields=list(kinds))
    offsets, upto = [], 0
    for end in ends:
        offsets.append(None if end is None else upto)
        upto = upto if end is None else end
    return pa.ListArray.from_arrays(pa.array([*offsets, upto], pa.int32()), values)


def _mentions(text: Column, patterns: Mapping[str, Sequence[str]], words: Mapping[str, Sequence[str]], merge: bool) -> Column:
    """The mentions of each text of an Arrow batch, each text walked once by every pattern and word."""
    compiled = {k: [re.compile(r) for r in regexes] for k, regexes in patterns.items()}
    words = {k: list(group) for k, group in words.items()}

    @F.arrow_udf(MENTIONS)
    def find(texts: pa.Array) -> pa.Array:
        rows, ends = [], []
        for value in texts:
            if (t := value.as_py()) is None:
                ends.append(None)
                continue
            found = _found(t, compiled, words)
            rows += _merged(found) if merge else found
            ends.append(len(rows))
        return _lists(rows, ends)

    return find(text)


def pattern_mentions(text: Column, patterns: Mapping[str, Sequence[str]] = lx.ENTITY_PATTERNS) -> Column:
    return _mentions(text, patterns, {}, merge=False)


def word_mentions(text: Column, words: Mapping[str, Sequence[str]] = lx.ENTITY_WORDS) -> Column:
    return _mentions(text, {}, words, merge=False)


def extract(
    docs: DataFrame,
    text: str = "text",
    patterns: Mapping[str, Sequence[str]] = lx.ENTITY_PATTERNS,
    words: Mapping[str, Sequence[str]] = lx.ENTITY_WORDS,
) -> DataFrame:
    """Cleaned text and its merged mentions as the array ``entities``.

    Offsets refer to the cleaned text.
    """
    bounded_batches(docs.sparkSession, 2)
    df = docs.withColumn("cleaned", clean_text(F.col(text)))
    return df.withColumn("entities", _mentions(F.col("cleaned"), patterns, words, merge=True))


def mention_rows(docs: DataFrame, key: str) -> DataFrame:
    return unnest(docs, [key], F.col("entities")).select(key, "text", "type", "start", "end", "confidence")


def extraction_statistics(mentions: DataFrame) -> DataFrame:
    """Mentions and distinct texts per type."""
    counted = mentions.groupBy("type", "text").agg(F.count(F.lit(1)).alias("__c"))
    return counted.groupBy("type").agg(F.sum("__c").alias("mentions"), F.count(F.lit(1)).alias("texts"))


def with_patterns(extra: Mapping[str, Sequence[str]], base: Mapping[str, Sequence[str]] = lx.ENTITY_PATTERNS) -> dict[str, list[str]]:
    """Defaults plus user patterns or words, for either table."""
    out = {k: list(v) for k, v in base.items()}
    for kind, more in extra.items():
        out.setdefault(kind, []).extend(more)
    return out
