"""Near-duplicate detection with DartMinHash signatures.

A text is a multiset of five-word shingles: the weight of a shingle is how often it stands, so
its region is as many unit cells. Darts fall into each cell as a Poisson stream hashed from the
cell alone, in order of rank, each with a hashed coordinate; a text keeps the darts below a rank
at which every coordinate has one with high probability, so the work is cells plus darts, not
cells times coordinates. The earliest dart of each coordinate is the signature; two signatures
agree in a coordinate with the probability of the weighted Jaccard similarity.

Bands of the signature are joined. Equal texts are one node from the start. In a bucket of a band
each node meets the bucket's least node; pairs are verified on the shingles themselves, and
links joined into components. A bucket that still holds several components is dealt out in
pairs of bounded blocks, in each of which all nodes meet on their shingles at once; a block
tells only links that join what was apart, at most one for each of its nodes. So every two
similar texts that share a bucket end in one class, and no group's pairs are ever listed.

Defined results: a null text is alone; texts without words are classes of equal texts; a text of
one to four words is one shingle; texts with equal 64-bit hash count as equal; repeated rows
share a class; a class takes the least id of its rows, null where all are null; an empty table
gives an empty result; other columns are not read. Cells are compared by 32-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import bounded_batches, mix, powers, small_pieces, word_hashes, written

SHINGLE = 5
BANDS, ROWS = 24, 5
_STEP = np.uint64(0xD1342543DE82EF95)
_TURN = 0x2545F4914F6CDD1D


def cells(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit cells (shingle, occurrence) of each text, and the number of each text."""
    words, offsets = word_hashes(column)
    counts = np.diff(offsets)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[text]
    power = powers(size, _TURN)
    hashes = np.zeros(len(text), np.uint64)
    for k in range(size):
        inside = at + k < offsets[text + 1]
        hashes += np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] * power[k], np.uint64(0)) if len(words) else np.uint64(0)
    hashes = mix(hashes)
    # equal shingles of a text stand together after sorting by a hash of both; their order is the occurrence
    key = mix(hashes ^ (text.astype(np.uint64) * _STEP))
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1])) if len(key) else np.empty(0, bool)
    place = np.arange(len(key))
    occurrence = place - np.maximum.accumulate(np.where(same, 0, place)) if len(key) else place
    out = np.empty(len(key), np.uint64)
    out[order] = mix(hashes[order] + occurrence.astype(np.uint64) * _STEP)
    return out, text


def dart_signatures(cell: np.ndarray, text: np.ndarray, n: int, k: int, part: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for ``n`` texts; ``part`` is the covered part of a cell (default 1).

    A text without cells keeps the greatest number everywhere.
    """
    none = np.uint64(2**64 - 1)
    earliest = np.full(n * k, none)
    weight = np.bincount(text, part, n) if part is not None else np.bincount(text, minlength=n).astype(float)
    upto = np.where(weight > 0, (math.log(k) + 2) / np.maximum(weight, 1e-300), 0.0)
    todo = np.arange(len(cell))
    while len(todo):
        live, rank, m = todo, np.zeros(len(todo)), 0
        while len(live):
            m += 1
            h = mix(cell[live] + np.uint64((m * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / k
            below = rank <= upto[text[live]]
            live, rank, h = live[below], rank[below], mix(h[below] ^ _STEP)
            thrown, at, g = live, rank, h
            if part is not None:
                hit = (mix(h + _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part[live]
                thrown, at, g = live[hit], rank[hit], h[hit]
            value = (at.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32))
            np.minimum.at(earliest, text[thrown] * k + (g & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, value)
        empty = (earliest.reshape(n, k) == none).any(1) & (weight > 0)
        upto = np.where(empty, upto * 2, 0.0)
        todo = np.flatnonzero(empty[text])
    return earliest.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), np.uint64(b + 1)) * _STEP
        for r in range(rows):
            h = mix(h ^ signatures[:, b * rows + r] & np.uint64(0xFFFFFFFF) ^ (h << np.uint64(7)))
        keys[:, b] = h
    return keys.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, node (hash of the text), cells, keys of every row; keys are empty without words."""
    read = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("node"), F.col(text_col).alias("text"))
    schema = read.select("id", "node", F.lit(0).cast("long").alias("cells"), F.array().cast("array<long>").alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches, 2):
            n = batch.num_rows
            cell, text = cells(batch.column(2))
            counts = np.bincount(text, minlength=n)
            keys = band_keys(dart_signatures(cell, text, n, bands * rows), bands, rows)[counts > 0]
            ends = np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], schema.names)

    return read.mapInArrow(run, schema)


def cell_sets(texts: DataFrame) -> DataFrame:
    """node, set (sorted 32-bit cell hashes as bytes) of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches, 1):
            cell, text = cells(batch.column(1))
            small = (cell >> np.uint64(32)).astype(np.uint32)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            sets = [np.sort(small[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    if len(a) > len(b):
        a, b = b, a
    # a place in the run of equals keeps repeated hashes apart
    first = np.searchsorted(a, a)
    left, right = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    return int((np.arange(len(a)) - first < right - left).sum())


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v of the pairs of nodes that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                both = common(a, b)
                on[i] = both >= least * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(on))

    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("set").alias(name))
    return written(pairs.join(of("v", "b"), "v").join(of("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links")


def block_links(nodes: list[int], roots: list[int], own: list[int], sets: list[np.ndarray], least: float, width: int = 4096) -> list[tuple[int, int]]:
    """Links between nodes of different roots, and of different blocks where there are two, that join what was apart.

    Intersections of all nodes come from products of the incidence matrix of shared cells, ``width`` columns at a time.
    """
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], np.float32)
    row, cell = np.repeat(np.arange(n), sizes.astype(int)), np.concatenate(sets)
    _, column, many = np.unique(cell, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((n, width), np.float32)
        np.add.at(part, (row[a:b], column[a:b] - start), 1)
        both += part @ part.T
    near = both >= np.float32(least) * (sizes[:, None] + sizes[None] - both) - 1e-4
    apart = np.array(roots)[:, None] != np.array(roots)[None]
    if len(set(own)) > 1:
        apart &= np.array(own)[:, None] != np.array(own)[None]
    root = {r: r for r in roots}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(near & apart, 1)), strict=True):
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            root[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def mixed_links(crowded: DataFrame, roots: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """u, v: links that join components in buckets that hold several."""
    tagged = crowded.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = mixed.where("n > 2 and lo <> hi").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    inside = tagged.join(mixed, "key").select("key", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = inside.join(sets, "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "set")

    def run(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(s, np.uint32) for s in table.column("set").to_pylist()]
        links = block_links(table.column("node").to_pylist(), table.column("root").to_pylist(), table.column("own").to_pylist(), held, least)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return written(dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long"), "mixed")


def near_roots(docs: DataFrame, signatures: DataFrame, text_col: str, least: float, block: int = 384) -> DataFrame:
    """node, root of every node that is linked to another one."""
    nodes = signatures.where("cells > 0").groupBy("node").agg(F.first("cells").alias("cells"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    bands = nodes.select("node", "cells", F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"), F.min_by("cells", "node").alias("head_cells")).where("n > 1")
    crowded = written(bands.join(heads, "key").select("key", "node", "cells", "head", "head_cells"), "crowded")

    ends = crowded.select("node").distinct()
    # equal texts merge before they travel
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    sets = written(cell_sets(texts.join(ends, "node", "left_semi")), "sets", "none")

    sized = F.least("cells", "head_cells") >= F.greatest("cells", "head_cells") * least
    pairs = crowded.where((F.col("node") != F.col("head")) & sized).select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    links = verified(pairs, sets, least)
    roots = written(components(links), "roots")
    more = mixed_links(crowded, roots, sets, least, block)
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id_col``, class_id, kept, node of every row.

    ``kept`` is true for the least id of a class (and its least node, where one id has several texts).
    """
    bounded_batches(docs.sparkSession, 4)
    signatures = written(signed(docs, id_col, text_col, bands, rows), "signatures")
    roots = near_roots(docs, signatures, text_col, least)
    placed = written(signatures.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root")), "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    # written, so that the join below is one that Spark can split for a large class
    heads = written(placed.where("root is not null").groupBy("root").agg(first), "heads")
    out = placed.join(heads, "root", "left")
    alone = F.col("root").isNull()
    kept = alone | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node")))
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), kept.alias("kept"), "node")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, with all columns, that are the first of their class; of rows with equal id and text one."""
    judged = written(near_duplicates(docs, id_col, text_col, least, bands, rows).select(F.col(id_col).alias("id_"), "node", "kept"), "judged")
    node = F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))
    keyed = docs.select(F.struct(*docs.columns).alias("row_"), F.col(id_col).alias("id"), node.alias("key"))

    def on(other: DataFrame):
        return keyed["id"].eqNullSafe(other["id_"]) & (keyed["key"] == other["node"])

    dropped = judged.where(~F.col("kept")).select("id_", "node").distinct()
    repeated = written(judged.where("kept and node is not null").groupBy("id_", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id_", "node"), "repeated")
    kept = keyed.join(dropped, on(dropped), "left_anti")
    if repeated.isEmpty():
        return kept.select("row_.*")
    ones = kept.join(repeated, on(repeated), "left_anti").select("row_")
    again = keyed.join(repeated, on(repeated), "left_semi").groupBy("id", "key").agg(F.first("row_").alias("row_")).select("row_")
    return ones.unionByName(again).select("row_.*")
