"""Relations between the entities of a text.

Every pair of mentions counts, but no pair of mentions is ever formed for patterns and
keywords: of all contexts between mentions of A and of B, each lies inside one of two,
from the first A to the last B or from the first B to the last A. A sweep of the shortest
spans at which a pattern or keyword occurs tells each entity the partners that have one
between, so only pairs that are related are put together, and only they leave the row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.columns import unnest
from tidemark.functions import lexicons as lx
from tidemark.operators.entities import word_starts
from tidemark.session import bounded_batches

RELATION = "struct<source:string,target:string,type:string,confidence:double,strength:double,evidence:string>"
ENTITIES = "array<struct<text:string,type:string,s0:int,e1:int,n:int,at:array<struct<start:int,end:int>>>>"
RULE = "struct<core:string,needed:array<string>,kind:string,confidence:double,two_way:boolean,sources:array<string>,targets:array<string>,words:array<string>>"
NO_WINDOWS = "cast(array() as array<struct<start:int,end:int,ord:int>>)"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
ENTITY_ARROW = pa.list_(pa.struct([("text", pa.string()), ("type", pa.string()), ("s0", pa.int32()), ("e1", pa.int32()), ("n", pa.int32()), ("at", pa.list_(_SPAN))]))


def _distinct_entities(mentions: Column) -> Column:
    """Per text and type, in order of first mention: first start, last end, mentions, all spans. One walk of the mentions."""

    @F.arrow_udf(ENTITIES)
    def gather(rows: pa.Array) -> pa.Array:
        out = []
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_pylist()
        start, end, text, kind = (pc.struct_field(rows.flatten(), [f]).to_pylist() for f in ("start", "end", "text", "type"))
        upto = 0
        for size in sizes:
            spans: dict[tuple, list[tuple]] = {}
            for i in range(upto, upto + size):
                spans.setdefault((text[i], kind[i]), []).append((start[i], end[i]))
            upto += size
            out.append([(*which, at[0][0], at[-1][1], len(at), at) for which, at in spans.items()])
        return pa.array(out, ENTITY_ARROW)

    return gather(mentions)


def _shortest(pattern: str) -> str:
    """The regex of the shortest spans of a pattern.

    A lazy group at either end of the pattern asks for one character there; a span that
    holds the pattern holds one of these spans, and the other way round.
    """
    core = re.sub(r"\((?!\?)", "(?:", pattern)
    lazy = "(?:.+?)"
    if core.startswith(lazy):
        core = "." + core[len(lazy):]
    if core.endswith(lazy):
        core = core[: -len(lazy)] + "."
    return core


def _needed(pattern: str) -> list[str]:
    """Texts without case that stand wherever the pattern does; none known for patterns with more than lazy groups."""
    parts = pattern.split("(.+?)")
    return [] if re.search(r"[\\.^$*+?{}\[\]|()]", "".join(parts)) else [p for p in parts if p and p.lower() == p.upper()]


def _pattern_windows(text: Column, core: Column) -> Column:
    """Spans (start, end, ord) of a regex in the text, one for every place it begins at."""
    cuts = F.split(F.concat(F.lit("\n"), text), F.concat(F.lit("(?iU)(?="), core, F.lit(")")), F.lit(-1))
    found = F.regexp_extract_all(text, F.concat(F.lit("(?iU)(?=("), core, F.lit("))")), F.lit(1))
    start = F.struct(F.lit(-1).alias("pos"), F.expr(NO_WINDOWS).alias("out"))
    pieces = F.zip_with(
        F.slice(cuts, 1, F.size(found)), found, lambda c, f: F.struct(F.length(c).alias("gap"), F.length(f).alias("size"))
    )

    def step(acc, x):
        at = acc["pos"] + x["gap"]
        window = F.struct(at.alias("start"), (at + x["size"]).alias("end"), F.lit(0).alias("ord"))
        return F.struct(at.alias("pos"), F.concat(acc["out"], F.array(window)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(F.expr(NO_WINDOWS))


def _keyword_windows(text: Column, places: Column, words: Column) -> Column:
    """Spans (start, end, place in the list) of every keyword, among the places where any list's keywords start."""
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def at(p):
        here = F.filter(numbered, lambda x: F.substring(text, p + 1, F.length(x["w"])) == x["w"])
        return F.transform(
            here, lambda x: F.struct(p.alias("start"), (p + F.length(x["w"])).alias("end"), x["i"].alias("ord"))
        )

    return F.when(F.exists(words, lambda w: text.contains(w)), F.flatten(F.transform(places, at))).otherwise(F.expr(NO_WINDOWS))


def _rules(patterns, keywords: Mapping[str, Sequence[str]]) -> Column:
    """The relation types as one constant; a pattern has no ``words``, a list of keywords no ``core``."""
    rules = [
        {"core": _shortest(p), "needed": _needed(p), "kind": kind, "confidence": sure, "two_way": both, "sources": list(sources), "targets": list(targets), "words": []}
        for kind, p, sure, both, sources, targets in patterns
    ]
    rules += [
        {"needed": [], "kind": kind, "confidence": 0.6, "two_way": False, "sources": [], "targets": [], "words": list(words)}
        for kind, words in keywords.items()
    ]
    return F.from_json(F.lit(json.dumps(rules, ensure_ascii=False)), f"array<{RULE}>")


def _met(row: Column, rules: Column) -> Column:
    """The rules that have a window in the text, with their windows ``w``."""
    windows = lambda r: F.when(F.size(r["words"]) > 0, _keyword_windows(row["t"], row["places"], r["words"])).otherwise(
        _pattern_windows(row["t"], r["core"])
    )
    possible = F.filter(rules, lambda r: F.forall(r["needed"], lambda x: row["t"].contains(x)))
    return F.filter(F.transform(possible, lambda r: r.withField("w", windows(r))), lambda r: F.size(r["w"]) > 0)


def _partners(row: Column, rule: Column, a: Column) -> Column:
    """The entities that have a window of the rule between them and ``a``, on either side.

    A window lies between a and a later b if it starts behind a's first start and ends before
    b's last end: of the windows that start behind a, the least end tells for all b at once,
    and as entities stand by their last end, those b are the first ones; likewise for an earlier b.
    """
    behind = F.array_min(F.filter(rule["ends"], lambda x: x["start"] >= a["s0"])["found"])
    before = F.array_max(F.filter(rule["starts"], lambda x: x["end"] <= a["e1"])["found"])

    def all_of(x):
        later = F.slice(row["late"], 1, F.coalesce(x["behind"]["n"], F.lit(0)))
        earlier = F.slice(row["e"], 1, F.coalesce(x["before"]["n"], F.lit(0)))
        return F.concat(later, F.filter(earlier, lambda b: x["behind"].isNull() | (b["e1"] < x["behind"]["at"])))

    # bound to a lambda variable, the bounds are computed once for all b
    met = F.flatten(F.transform(F.array(F.struct(behind.alias("behind"), before.alias("before"))), all_of))
    typed = lambda b: (F.size(rule["targets"]) == 0) | F.array_contains(rule["targets"], b["type"])
    return F.filter(met, lambda b: typed(b) & ((a["text"] != b["text"]) | (a["type"] != b["type"]) | (a["n"] > 1)))


def _bounds(row: Column, rule: Column) -> Column:
    """``rule`` with the ends and starts of its windows, and how many entities end behind or start before each."""
    ends = F.transform(
        rule["w"],
        lambda w: F.struct(w["start"].alias("start"), F.struct(w["end"].alias("at"), F.size(F.filter(row["e"], lambda b: b["e1"] >= w["end"])).alias("n")).alias("found")),
    )
    starts = F.transform(
        rule["w"],
        lambda w: F.struct(w["end"].alias("end"), F.struct(w["start"].alias("at"), F.size(F.filter(row["e"], lambda b: b["s0"] <= w["start"])).alias("n")).alias("found")),
    )
    return rule.withField("ends", ends).withField("starts", starts)


def _evidence(row: Column, rule: Column, a: Column, b: Column, found: Column) -> Column:
    """The first keyword of the list that was met, or the text a pattern was met in.

    Of all contexts that hold the first window, that text is the shortest: mentions do
    not overlap, so the nearest mention before it and the nearest behind it are its ends.
    """
    keyword = F.try_element_at(rule["words"], F.array_min(F.transform(found, lambda w: w["ord"])) + 1)
    window = F.element_at(found, 1)

    def tight(x, y):
        before = F.array_max(F.transform(F.filter(x["at"], lambda m: m["start"] <= window["start"]), lambda m: m["start"]))
        behind = F.array_min(F.transform(F.filter(y["at"], lambda m: m["end"] >= window["end"]), lambda m: m["end"]))
        return F.when(before.isNotNull() & behind.isNotNull(), F.struct((behind - before).alias("size"), before.alias("start")))

    # an entity beside itself needs two mentions: the first and the last hold them all
    whole = F.struct((a["e1"] - a["s0"]).alias("size"), a["s0"].alias("start"))
    same = (a["text"] == b["text"]) & (a["type"] == b["type"])
    best = F.when(same, whole).otherwise(F.array_min(F.array(tight(a, b), tight(b, a))))
    text = F.flatten(F.transform(F.array(best), lambda x: F.array(F.substring(row["t"], x["start"] + 1, x["size"]))))
    return F.when(F.size(rule["words"]) > 0, keyword).otherwise(text[0])


def _relations(row: Column, rule: Column, a: Column, b: Column) -> Column:
    """What the rule says of a and b: one relation, or one in either direction."""
    found = F.filter(
        rule["w"],
        lambda w: ((w["start"] >= a["s0"]) & (w["end"] <= b["e1"])) | ((w["start"] >= b["s0"]) & (w["end"] <= a["e1"])),
    )

    def told(source, target, factor, evidence):
        return F.struct(
            source["text"].alias("source"), target["text"].alias("target"), rule["kind"].alias("type"),
            (rule["confidence"] * factor).alias("confidence"), F.lit(1.0).alias("strength"), evidence.alias("evidence"),
        )

    def both(evidence):
        one = told(a, b, 1.0, evidence)
        return F.when(rule["two_way"], F.array(one, told(b, a, 0.9, evidence))).otherwise(F.array(one))

    evidence = F.transform(F.array(found), lambda f: _evidence(row, rule, a, b, f))
    return F.flatten(F.transform(evidence, both))


def between_entities(text: Column, patterns=lx.RELATION_PATTERNS, keywords: Mapping[str, Sequence[str]] = lx.RELATION_KEYWORDS) -> Column:
    """Pattern and keyword relations of one text.

    The rules are data: one expression serves all of them, and looks only at the rules that
    have a window in the text and at the pairs that have one between them. Entities and
    windows are bound to a lambda variable, so each is computed once per text.
    """
    if not patterns and not keywords:
        return F.expr(f"cast(array() as array<{RELATION}>)")

    def of_rule(row, rule):
        typed = lambda a: (F.size(rule["sources"]) == 0) | F.array_contains(rule["sources"], a["type"])
        of_one = lambda a: F.flatten(F.transform(_partners(row, rule, a), lambda b: _relations(row, rule, a, b)))
        return F.flatten(F.transform(F.filter(row["e"], typed), of_one))

    every = sorted({w for words in keywords.values() for w in words})
    places = word_starts(text, every) if every else F.expr("cast(array() as array<int>)")
    found = F.struct(text.alias("t"), _distinct_entities(F.col("entities")).alias("e"), places.alias("places"))
    ordered = lambda x: x.withField("late", F.array_sort(x["e"], lambda a, b: b["e1"] - a["e1"]))
    row = F.transform(F.array(found), ordered)
    rules = _rules(patterns, keywords)
    return F.flatten(F.flatten(F.transform(row, lambda x: F.transform(F.transform(_met(x, rules), lambda r: _bounds(x, r)), lambda r: of_rule(x, r)))))


def by_distance(reach: int = 100, table: Mapping[tuple[str, str], str] = lx.NEAR_RELATIONS) -> Column:
    """Relations of mentions at most ``reach`` characters apart, typed by their types.

    Mentions do not overlap, so at most ``reach`` of them start in that span: each looks
    only at the ones behind and ahead of it.
    """
    e = F.col("entities")
    kinds = F.create_map(*[x for (s, t), r in table.items() for x in (F.lit(f"{s}>{t}"), F.lit(r))])

    def near(m, i):
        others = F.concat(
            F.slice(e, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach))), F.slice(e, i + 2, reach)
        )
        def kind(o):
            return F.try_element_at(kinds, F.concat(m["type"], F.lit(">"), o["type"]))

        def gap(o):
            return F.abs(m["start"] - o["start"])

        close = F.filter(others, lambda o: (gap(o) <= reach) & kind(o).isNotNull())
        return F.transform(
            close,
            lambda o: F.struct(
                m["text"].alias("source"),
                o["text"].alias("target"),
                kind(o).alias("type"),
                F.lit(0.4).alias("confidence"),
                (1.0 - gap(o) / reach).alias("strength"),
                F.lit("distance").alias("evidence"),
            ),
        )

    return F.flatten(F.transform(e, near))


def extract_relations(
    docs: DataFrame,
    key: str,
    patterns=lx.RELATION_PATTERNS,
    keywords: Mapping[str, Sequence[str]] = lx.RELATION_KEYWORDS,
    table: Mapping[tuple[str, str], str] = lx.NEAR_RELATIONS,
) -> DataFrame:
    """All relations of documents with ``cleaned`` and ``entities``, merged per document."""
    bounded_batches(docs.sparkSession, 2)
    found = F.concat(between_entities(F.col("cleaned"), patterns, keywords), by_distance(100, table))
    return merge_relations(unnest(docs, [key], found), [key])


def merge_relations(relations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per (source, type, target): highest confidence and strength, all evidence.

    Evidence is made distinct before it is gathered, so a relation seen a billion times
    gathers its few different words. The text of a pattern differs by document: merge it
    with the document among ``keys``, or leave it out where documents are merged.
    """
    on = [*keys, "source", "type", "target"]
    slim = relations.groupBy(*on, "evidence").agg(F.max("confidence").alias("confidence"), F.max("strength").alias("strength"))
    return slim.groupBy(*on).agg(
        F.max("confidence").alias("confidence"),
        F.max("strength").alias("strength"),
        F.sort_array(F.collect_list("evidence")).alias("evidence"),
    )


def relations_of(relations: DataFrame, entity: str) -> DataFrame:
    return relations.where((F.col("source") == entity) | (F.col("target") == entity))


def search_relations(relations: DataFrame, source: str | None = None, target: str | None = None, types: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """By weight times confidence, best first."""
    out = relations
    if source is not None:
        out = out.where(F.col("source") == source)
    if target is not None:
        out = out.where(F.col("target") == target)
    if types:
        out = out.where(F.col("type").isin(list(types)))
    return out.orderBy((F.col("strength") * F.col("confidence")).desc(), "source", "target", "type").limit(limit)
