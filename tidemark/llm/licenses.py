"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined, by hash and words, to the k-grams of license
templates. A hit votes for the diagonal ``position in text - position in template``. Votes are
counted for each text, template and diagonal; neighbouring diagonals (words put in or left out)
that overlap in the text are merged; a merged span is verified by the share of the template's
words that its k-grams cover and by its length against the template's. One changed word costs
``k`` k-grams but one word. Where a span holds too few k-grams and a template of another label
covers more of itself on the same words, only the latter counts: public licenses differ by a word.

The templates are a table given by the caller; its characters are counted, and its k-grams are
broadcast up to ``BROADCAST_CHARS`` of them and joined by a shuffle beyond. What is grouped
afterwards is one text's hits, never a template's.

Defined results: a null text is empty, and an empty text has no words, labels or places; rows
are matched to their hits by id and text, so repeated rows get equal results and null ids their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is not part of a word: ASCII but for digits and a-z.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Templates of at most so many characters together are broadcast; more are joined by a shuffle.
BROADCAST_CHARS = 2_000_000

#: Fixed phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Opening sentences of public licenses and usual notices, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
)


def plain(text: Column) -> Column:
    """The words in lower case (A-Z only), one blank between them."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.trim(F.regexp_replace(low, GAPS, " "))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(plain(text), " "), "")


def rolling(words: Column, k: int) -> Column:
    """Structs (h, g, i) of every window of ``k`` words: hash, words, place from 0."""
    gram = lambda i: F.array_join(F.slice(words, i + 1, k), " ")
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(F.xxhash64(gram(i)).alias("h"), gram(i).alias("g"), i.alias("i"))))


def template_grams(docs: DataFrame, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """h, g, template, label, t_pos, t_grams of every k-gram of the templates."""
    rows = docs.sparkSession.createDataFrame([(n, label, text) for n, (label, text) in enumerate(templates)], "template int, label string, text string")
    words = rows.select("template", "label", words_of(F.col("text")).alias("words"))
    grams = words.select("template", "label", rolling(F.col("words"), k).alias("grams"))
    out = grams.select("template", "label", F.size("grams").alias("t_grams"), F.inline("grams")).withColumnRenamed("i", "t_pos").withColumnRenamed("g", "t_gram")
    return F.broadcast(out) if sum(len(text) for _, text in templates) <= BROADCAST_CHARS else out


def diagonal_spans(rows: DataFrame, templates: DataFrame, k: int, drift: int, least: float) -> DataFrame:
    """id, text_hash, label, first, last, share, cover: verified spans of templates in the texts of ``rows`` (id, text).

    ``share`` is the share of the template's k-grams found, ``cover`` that of its words they hold.
    """
    words = rows.select("id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    grams = words.select("id", "text_hash", F.inline(rolling(F.col("words"), k)))
    hits = grams.join(templates, (grams["h"] == templates["h"]) & (F.col("g") == F.col("t_gram"))).select("id", "text_hash", "template", "label", "t_grams", "t_pos", F.col("i").alias("pos"))
    text, diagonal = ["id", "text_hash", "template", "label", "t_grams"], (F.col("pos") - F.col("t_pos")).alias("diagonal")
    # repeated rows vote once: places are distinct before they are counted
    votes = hits.select(*text, diagonal, "t_pos").groupBy(*text, "diagonal").agg(F.array_sort(F.collect_set("t_pos")).alias("places"))
    ends = votes.select(*text, "diagonal", "places", (F.col("diagonal") + F.element_at("places", 1)).alias("first"), (F.col("diagonal") + F.element_at("places", -1) + k - 1).alias("last"))
    by_text = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal", "first")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_text) > drift) | (F.col("first") > F.max("last").over(by_text.rowsBetween(Window.unboundedPreceding, -1)) + drift), F.lit(True))
    merged = (
        ends.withColumn("run", F.sum(new.cast("int")).over(by_text))
        .groupBy(*text, "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    )
    share = F.size("places") / F.col("t_grams")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1))))
    cover = F.size(covered) / (F.col("t_grams") + k - 1)
    fits = F.col("last") - F.col("first") + 1 <= (F.col("t_grams") + k - 1) * (2 - least) + drift
    return merged.where((cover >= least) & fits).select("id", "text_hash", "label", "first", "last", share.alias("share"), cover.alias("cover"))


def own_spans(spans: Column, least: float) -> Column:
    """Spans with ``least`` of the k-grams, and those that no span of another label covers better on the same words."""
    better = lambda s: F.exists(spans, lambda o: (o["label"] != s["label"]) & (o["first"] <= s["last"]) & (s["first"] <= o["last"]) & (o["cover"] > s["cover"]))
    own = F.filter(spans, lambda s: (s["share"] >= least) | ~better(s))
    return F.array_sort(F.array_distinct(F.transform(own, lambda s: F.struct(s["label"].alias("label"), s["first"].alias("first"), s["last"].alias("last"), s["share"].alias("share")))))


def phrase_places(words: Column, text: Column, phrase: str) -> Column:
    """Places where the phrase's words stand; only texts that hold the phrase are walked word by word."""
    parts = phrase.split(" ")
    stands = lambda i: reduce(lambda a, b: a & b, (words[i + n] == p for n, p in enumerate(parts)))
    none = F.array().cast("array<int>")
    walk = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
    return F.when(F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {phrase} ")), walk).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, k: int = 3, drift: int = 4, least: float = 0.8) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    ``score`` is the best share of a template's k-grams found, 1 where a fixed phrase stands, else 0.
    ``spans`` are (label, first, last, share) of the verified templates, in order.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = diagonal_spans(rows, template_grams(docs, templates, k), k, drift, least)
    every_span = spans.groupBy("id", "text_hash").agg(F.collect_set(F.struct("label", "first", "last", "share", "cover")).alias("every"))
    found = every_span.select("id", "text_hash", own_spans(F.col("every"), least).alias("spans"))

    read = rows.select("id", F.xxhash64("text").alias("text_hash"), plain(F.col("text")).alias("plain"))
    split = read.select("id", "text_hash", "plain", F.array_remove(F.split("plain", " "), "").alias("words"))
    placed = split.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), *(phrase_places(F.col("words"), F.col("plain"), p).alias(f"p{n}") for n, (p, _) in enumerate(phrases)))
    every = F.concat(*(F.col(f"p{n}") for n in range(len(phrases))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(phrases))))
    base = placed.select(
        "id",
        "text_hash",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_list"),
    )
    out = base.alias("b").join(found.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.text_hash") == F.col("f.text_hash")), "left")
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform("f.spans", lambda s: s["label"]), none)
    best = F.coalesce(F.array_max(F.transform("f.spans", lambda s: s["share"])), F.lit(0.0))
    return out.select(
        F.col("b.id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.coalesce(F.col("f.spans"), F.array().cast("array<struct<label:string,first:int,last:int,share:double>>")).alias("spans"),
    )


def scan_licenses_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, k: int = 3, drift: int = 4, least: float = 0.8) -> str:
    """DuckDB SQL over ``documents`` for the rows of ``scan_licenses``, spans told as text."""
    words = lambda x: f"regexp_extract_all(translate({x}, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    wanted = ", ".join(f"({n}, {quoted(label)}, {quoted(text)})" for n, (label, text) in enumerate(templates))
    fixed = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in phrases)
    gram = f"array_to_string(w[i + 1 : i + {k}], ' ')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
    t(template, label, w) AS (SELECT n, l, {words('x')} FROM (VALUES {wanted}) v(n, l, x)),
    tg AS (SELECT template, label, len(w) - {k - 1} AS t_grams, i AS t_pos, {gram} AS g FROM t, unnest(range(0, greatest(len(w) - {k - 1}, 0))) r(i)),
    dg AS (SELECT rid, i AS pos, {gram} AS g FROM docs, unnest(range(0, greatest(len(w) - {k - 1}, 0))) r(i)),
    hits AS (SELECT DISTINCT rid, template, label, t_grams, pos - t_pos AS diagonal, t_pos FROM dg JOIN tg USING (g)),
    votes AS (SELECT rid, template, label, t_grams, diagonal, min(t_pos) + diagonal AS first, max(t_pos) + diagonal + {k - 1} AS last, list(t_pos) AS places FROM hits GROUP BY 1, 2, 3, 4, 5),
    marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal, first) <= {drift}
      AND first <= max(last) OVER (PARTITION BY rid, template ORDER BY diagonal, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {drift} THEN 0 ELSE 1 END AS new FROM votes),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal, first) AS run FROM marked),
    merged AS (SELECT rid, template, label, t_grams, run, min(first) AS first, max(last) AS last, len(list_distinct(flatten(list(places)))) AS found FROM runs GROUP BY 1, 2, 3, 4, 5),
    spans AS (SELECT DISTINCT rid, label, first, last, found::DOUBLE / t_grams AS share FROM merged
      WHERE found::DOUBLE / t_grams >= {least}::DOUBLE AND last - first + 1 <= (t_grams + {k - 1}) * (2 - {least}::DOUBLE) + {drift}),
    told AS (SELECT rid, string_agg(label || ':' || first || ':' || last, ',' ORDER BY label, first, last, share) AS spans, max(share) AS best, list(DISTINCT label) AS own FROM spans GROUP BY 1),
    places AS (SELECT rid, label, i FROM docs, (VALUES {fixed}) p(phrase, label, n), unnest(range(0, greatest(len(w) - n + 1, 0))) r(i) WHERE array_to_string(w[i + 1 : i + n], ' ') = phrase),
    base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(own, [])))), ','), '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN told USING (rid) LEFT JOIN base USING (rid)"""
