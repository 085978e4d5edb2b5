"""Text cleaning, sentences, similarity and triple ids as columns."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# What text cleaning keeps besides CJK, letters and digits.
KEPT_MARKS = " \\t\\n\\x0B\\f\\r.,;:!?()\\[\\]{}\"'-"
# Signs that dates, percentages and amounts need; kept unless the strict form is asked for.
VALUE_SIGNS = "%$/"


def collapse(text: Column) -> Column:
    """One space for each run of white space; a space that stands alone needs no replacement."""
    return F.regexp_replace(text, "\\s{2,}|[\\t\\n\\x0B\\f\\r]", " ")


def clean_text(text: Column, keep_value_signs: bool = True) -> Column:
    """One space for each run of white space; only words and plain punctuation stay."""
    extra = VALUE_SIGNS if keep_value_signs else ""
    # listed one by one, letters and digits share one bit table with the marks; runs go at once
    other = f"[^\\u4e00-\\u9fa5{ascii_letters}{digits}{extra}{KEPT_MARKS}]++"
    return F.trim(F.regexp_replace(collapse(text), other, ""))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, "[。！？；\\n]"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def triple_id(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", subject, predicate, obj)), 1, 16)


def confidence_level(c: Column) -> Column:
    return (
        F.when(c <= 0.2, "very_low")
        .when(c <= 0.4, "low")
        .when(c <= 0.6, "medium")
        .when(c <= 0.8, "high")
        .otherwise("very_high")
    )


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, .8 if one holds the other, else 1 - edit distance / longer length."""
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return (
        F.when(empty, 0.0)
        .when(a == b, 1.0)
        .when(a.contains(b) | b.contains(a), 0.8)
        .otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )
