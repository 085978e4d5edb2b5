"""Exact Jaccard join of word-shingle sets in size-banded tiles with hashed bitmap signatures.

Equal sets are one node. Shingles have one global order, those in few texts first: a sketch of
``COUNTERS`` counts, added up over all texts, gives each its class of frequency, and a hash the
order inside a class; any order gives whole results, this one keeps common passages out of the
way. Two sets of n and m shingles that reach the threshold share one of the first ``n - ceil(t n)
+ 1`` and ``m - ceil(t m) + 1`` in that order, and lie in one band of sizes or in neighbouring
ones (a band is a factor of 1 / t). So a tile is a shingle and a band, with the band above; a pair
need only be met where its first common shingle is early enough in both to leave the overlap.

A node has a bitmap of its hashed shingles. For a pair, bits set on one side alone count shingles
that the other side lacks, which bounds the overlap from above; only pairs that may reach it are
settled by intersecting their sorted arrays. In each tile all nodes meet the least one of
their band and of the next. Links are joined into components; a tile that still holds several
is dealt out in pairs of bounded blocks, which first mark nodes by bitmaps and then tell at most a
link for each node that joins what was apart. So no link between components is lost, and no
group's pairs are listed.

Defined results: words are runs without white space, with A-Z as a-z; texts without words, and
null texts, have no shingles and are alone; a text of one to three words is one shingle; repeated
rows share a component; a component takes the least id of its rows, null where all are null;
an empty table gives an empty result; other columns are not read. Shingles and sets are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.components import components
from tidemark.llm.shared import bounded_batches, mix, powers, small_pieces, word_hashes, written
from tidemark.llm.sketch import BLOCK, Sketch, counter_blocks, merged_blocks

SHINGLE = 4
#: A pair is linked when 100 * overlap >= PERCENT * union.
PERCENT = 85
#: Counters of shingle frequencies: a shingle stands out once it is in more texts than a counter holds others.
COUNTERS = 1 << 20
#: Turns in which tiles with several components get their sets, and bytes of sets that are one turn.
TURNS = 8
TURN_BYTES = 8 << 20
_TURN = 0x2545F4914F6CDD1D
_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64((1 << 58) - 1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes(column, marks=True)
    counts = np.diff(offsets)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(windows)
    text = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(text)) - (ends - windows)[text] + offsets[text]
    power = powers(size, _TURN)
    hashes = np.zeros(len(text), np.uint64)
    if len(words):
        padded = np.concatenate((words, np.zeros(size, np.uint64)))
        for k in range(size):
            term = padded[at + k] * power[k]
            short = counts[text] <= k
            if short.any():
                term[short] = 0
            hashes += term
    hashes = mix(hashes + np.minimum(counts, size).astype(np.uint64)[text])
    return [np.unique(hashes[b - n : b]) for n, b in zip(windows.tolist(), ends.tolist(), strict=True)]


def node_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; of the empty set 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        every = np.concatenate([sets[i] for i in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        out[some] = mix(np.add.reduceat(mix(every ^ _STEP), starts) + sizes[some].astype(np.uint64) * _STEP) | np.uint64(1)
    return out.view(np.int64)


def set_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, node of every row; with block, cells, counts rows of partial frequencies among them."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", read.schema["id"].dataType), *(StructField(c, LongType()) for c in ("n", "node", "block")), *(StructField(c, BinaryType()) for c in ("cells", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = np.zeros(COUNTERS, np.int64), None
        for batch in small_pieces(batches, 1):
            sets = shingle_sets(batch.column(1))
            kind, m = batch.schema.field(0).type, len(sets)
            if m:
                np.add.at(held, (np.concatenate(sets) >> np.uint64(44)).astype(np.int64), 1)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(node_ids(sets)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema.names)
        found = counter_blocks(held)
        if m := found.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *found.columns], schema.names)

    return read.mapInArrow(run, schema)


def frequency_classes(partial: DataFrame) -> np.ndarray:
    """The binary logarithm of each counter, all texts added up."""
    out = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint8)
    told = lambda counter: np.floor(np.log2(np.maximum(counter, 1))).astype(np.uint8).tobytes()
    for block, held in merged_blocks(partial.select("block", "cells", "counts"), told, np.dtype("<u2")).collect():
        out[block] = np.frombuffer(held, np.uint8)
    return out.ravel()


def prefix(shingles: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, in the global order, as many as two similar sets cannot both miss."""
    n = len(shingles)
    p = n - -(-percent * n // 100) + 1
    # the place in the order also tells shingles apart
    order = classes[(shingles >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | mix(shingles) & _LOW
    return np.sort(np.partition(order, p - 1)[:p] if p < n else order)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Hashed bits of a set: the least power of two of them that is not below its size, 64 at least."""
    width = max(64, 1 << max(len(shingles) - 1, 0).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of as many words: bits that fall together are one."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def signed_nodes(docs: DataFrame, text_col: str, classes: np.ndarray, percent: int) -> DataFrame:
    """node, n, bits, keys (the prefix in order), text_hash of the nodes of every task's texts, each once a task."""
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small_pieces(batches, 1):
            sets, hashes = shingle_sets(batch.column(1)), batch.column(0).to_numpy()
            nodes, out = node_ids(sets), []
            for i in np.flatnonzero(nodes).tolist():
                if (node := int(nodes[i])) not in seen:
                    seen.add(node)
                    out.append((node, len(sets[i]), bitmap(sets[i]).tobytes(), prefix(sets[i], held.value, percent).view(np.int64), int(hashes[i])))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "n", "bits", "keys", "text_hash"])

    return docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, "node long, n long, bits binary, keys array<long>, text_hash long")


def wanted_sets(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """node, set of ``nodes`` (node, text_hash), from another reading of the texts.

    A sketch of the wanted hashes is sent to all tasks, so that no text is shuffled, and shingles
    of no other text are made but for its few false answers.
    """
    nodes = written(nodes, "wanted")
    filled = Sketch(nodes.select("text_hash"), lambda batch: node_words(batch.column(0).to_numpy()), nodes.count(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small_pieces(batches, 1):
            hashes = batch.column(0).to_numpy()
            on = filled.met(node_words(hashes))
            for i in np.flatnonzero(on).tolist():
                on[i] = (text := int(hashes[i])) not in seen
                seen.add(text)
            if on.any():
                sets = shingle_sets(batch.column(1).filter(pa.array(on)))
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    found = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, "node long, set binary")
    sets = found.groupBy("node").agg(F.first("set").alias("set"))
    return written(sets.join(nodes.select("node").distinct(), "node", "left_semi"), "sets", "none")


def node_words(nodes: np.ndarray) -> np.ndarray:
    """The two words of a sketch that a node gives."""
    words = nodes.view(np.uint64)
    return np.stack((words, mix(words ^ _STEP)), axis=1)


# --- pairs


def may_reach(n: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap with each of ``others`` (bitmaps of the same width) may be large enough."""
    shorter, longer = np.minimum(sizes, n), np.maximum(sizes, n)
    at_most = np.minimum(n - np.bitwise_count(bits & ~others).sum(1, dtype=np.int64), sizes - np.bitwise_count(others & ~bits).sum(1, dtype=np.int64))
    return (100 * shorter >= percent * longer) & ((100 + percent) * at_most >= percent * (sizes + n))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold, by their exact intersection."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def joined_ends(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (u, v) with the columns of both ends, those of u first."""
    side = lambda end: of.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", *(f"{c}_u" for c in columns), *(f"{c}_v" for c in columns))


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps let them reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.zeros(batch.num_rows, bool)
            for i, (n, a, m, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                words = min(len(a), len(b))
                on[i] = may_reach(n, folded(a, words), np.array([m]), folded(b, words)[None], percent)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(on))

    return joined_ends(pairs, nodes, "n", "bits").mapInArrow(run, "u long, v long")


def settled_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [linked(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(on, pa.bool_()))

    return joined_ends(pairs, sets, "set").mapInArrow(run, "u long, v long")


# --- tiles that hold several components


#: Columns of a tile's rows: the tile (a shingle, a band and a pair of blocks), then the node, whether
#: it is of the band above, its block, its component, its size, and the shingle's place in its order.
TILE = "key long, band int, i int, j int, node long, high int, own int, root long, n long, pos int"
_TILE = [c.split()[0] for c in TILE.split(", ")]


def tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows of each tile, by columns, from rows that are sorted by tile."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(len(_TILE))]
        columns += [np.fromiter(batch.column(c).to_pylist(), object, batch.num_rows) for c in range(len(_TILE), batch.num_columns)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns[:4]:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            tile = tuple(c[a] for c in columns[:4])
            if tile != now:
                if parts:
                    yield [np.concatenate(c) for c in zip(*parts, strict=True)]
                now, parts = tile, []
            parts.append([c[a:b] for c in columns])
    if parts:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)]


def tile_marks(root: np.ndarray, high: np.ndarray, own: np.ndarray, sizes: np.ndarray, pos: np.ndarray, bitmaps: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows, and the later rows that each may be linked with: of another root, not both of the band above, and of another block where there are two."""
    held, bits = [np.frombuffer(b, "<u8") for b in bitmaps], None
    words = min(map(len, held))
    two = (own != own[0]).any()
    for i in range(len(root) - 1):
        later = slice(i + 1, None)
        need = -(-percent * (sizes[later] + sizes[i]) // (100 + percent))
        apart = (root[later] != root[i]) & (pos[i] <= sizes[i] - need) & (pos[later] <= sizes[later] - need)
        if high[i]:
            apart &= high[later] == 0
        if two:
            apart &= own[later] != own[i]
        near = np.flatnonzero(apart) + i + 1
        if len(near):
            if bits is None:
                bits = np.stack([folded(b, words) for b in held])
            near = near[may_reach(int(sizes[i]), bits[i], sizes[near], bits[near], percent)]
            if len(near):
                yield i, near


def tile_links(nodes: list[int], roots: list[int], marks: Iterator[tuple[int, np.ndarray]], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of the tile that join what was apart."""
    root = {r: r for r in roots}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, near in marks:
        for j in near.tolist():
            a, b = find(roots[i]), find(roots[j])
            if a != b and linked(sets[i], sets[j], percent):
                root[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def early_in(percent: int) -> Column:
    """Whether a set may hold its first shingle in common with a similar set of its size or more at ``pos``."""
    return F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))


def mixed_links(crowded: DataFrame, roots: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, block: int) -> DataFrame:
    """u, v: links that join components in tiles that hold several and have pairs that no least node was in."""
    tagged = crowded.join(roots, "node", "left").select("key", "band", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    placed = tagged.withColumn("high", F.lit(0)).unionByName(tagged.withColumn("high", F.lit(1)).withColumn("band", F.col("band") - 1))
    # the smaller set of a pair is in the lower band
    early = (F.col("high") == 0) & early_in(percent)
    tiles = placed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("of"), F.sum("high").alias("highs"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or(early).alias("early"))
    tiles = tiles.where("early and lo <> hi and (of - highs > 2 or highs > 1)").select("key", "band", F.ceil(F.col("of") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    inside = placed.join(tiles, ["key", "band"]).select("*", own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = inside.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "high", "own", "root", "n", "pos")

    def by_tile(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_TILE[:4]).sortWithinPartitions(*_TILE[:4])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, band, i, j, node, high, own, root, n, pos, bits in tile_runs(batches):
            on = np.zeros(len(node), bool)
            for at, near in tile_marks(root, high, own, n, pos, bits.tolist(), percent):
                on[at] = on[near] = True
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (key, band, i, j, node, high, own, root, n, pos)], _TILE)

    marked = written(by_tile(dealt.join(nodes.select("node", "bits"), "node").select(*_TILE, "bits")).mapInArrow(mark, TILE), "marked")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, node, high, own, root, n, pos, held in tile_runs(batches):
            held = [np.frombuffer(s, "<u8") for s in held]
            marks = tile_marks(root, high, own, n, pos, [bitmap(s).tobytes() for s in held], percent)
            if links := tile_links(node.tolist(), root.tolist(), marks, held, percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["u", "v"])

    sets = sets_of(marked.select("node").distinct())
    # a set goes to every tile of its node: the tiles take turns, and a turn's shuffle goes before the next
    turns = TURNS if 8 * (marked.agg(F.sum("n")).first()[0] or 0) > TURN_BYTES else 1
    found = []
    for turn in range(turns):
        now = marked.where(F.pmod(F.xxhash64(*_TILE[:4]), F.lit(turns)) == turn)
        found.append(written(by_tile(now.join(sets, "node").select(*_TILE, "set")).mapInArrow(settle, "u long, v long"), "mixed"))
    return reduce(DataFrame.unionByName, found)


# --- the join


def linked_nodes(docs: DataFrame, classes: np.ndarray, text_col: str, percent: int, block: int) -> DataFrame:
    """node, root of every node that is linked to another one."""
    signed = signed_nodes(docs, text_col, classes, percent)
    nodes = written(signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "bits", "keys", "text_hash"))), "nodes")
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    # of a similar pair, the smaller set has its first common shingle early
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.bool_or(early_in(percent)).alias("early")).where("of > 1 and early").select("key")
    keyed = keyed.drop("n")
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9).cast("int")
    crowded = written(keyed.join(shared, "key").join(nodes.select("node", "n", band.alias("band")), "node"), "crowded")

    def sets_of(some: DataFrame) -> DataFrame:
        return wanted_sets(docs, text_col, nodes.select("node", "text_hash").join(some, "node", "left_semi"))

    heads = crowded.groupBy("key", "band").agg(F.min("node").alias("head"))
    to_heads = crowded.select("node", "key", F.explode(F.array("band", F.col("band") + 1)).alias("band")).join(heads, ["key", "band"]).where("node <> head")
    pairs = written(to_heads.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct(), "pairs")
    near = written(bounded_pairs(pairs, nodes, percent), "near")
    sets = sets_of(near.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    roots = written(components(written(settled_pairs(near, sets, percent), "links")), "roots")
    more = mixed_links(crowded, roots, nodes, sets_of, percent, block)
    if more.isEmpty():
        return roots
    return written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "roots")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = 512) -> DataFrame:
    """``id_col``, n_shingles, component_id, node of every row."""
    bounded_batches(docs.sparkSession, 4)
    every = written(set_facts(docs, id_col, text_col), "facts")
    facts = every.where("block is null").select("id", "n", "node")
    roots = linked_nodes(docs, frequency_classes(every.where("block is not null")), text_col, percent, block)
    least = written(facts.where("n > 0").groupBy("node").agg(F.min("id").alias("least")), "least")
    rooted = least.join(roots, "node", "left")
    firsts = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("first"))
    # written, so that the join below is one that Spark can split for a large class
    known = written(rooted.join(firsts, "root", "left").select("node", F.coalesce("first", "least").alias("component_id")), "known")
    return facts.join(known, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "node")


def jaccard_components_sql() -> str:
    return r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS met
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT u, v FROM shared WHERE 100 * met >= 85 * (total - met)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sets
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
