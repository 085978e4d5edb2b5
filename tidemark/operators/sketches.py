"""Sketches of the nodes within 1, 2, 3 .. steps of each node, over blocks of edges.

A sketch is a row of registers, and registers do not depend on each other, so a slice of the
registers of all nodes goes through the rounds by itself. Where a task can hold some registers of all
nodes, it takes a slice through all rounds and reads the edges from the shared folder, a block at a
time, in each (``alone``): nothing is shuffled. A graph with more nodes goes in shares of the registers, one after the
other: in a round each part tells each other part the changed rows of those of its nodes that have
neighbours there (``together``), and memory and disk hold a share. Both give the same registers.
What is kept of a round is, for each changed row, by how much its number of empty registers and
its sum of powers changed; all estimates follow from these. Hashes and estimates are those of
Spark's ``hll_sketch_agg`` and ``hll_sketch_estimate``.

Sets of at most ``EXACT`` nodes are lists of ids and counted exactly; the registers tell which lists
can be that short before any is sent.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import LEAST_EDGES, Blocks, rows_of
from tidemark.session import Bucketed, Kept, cut_lineage

# sets up to this size are counted exactly
EXACT = 384
# registers of a node that a task takes at least and at most where it takes those of all nodes
LEAST_WIDTH, MOST_WIDTH = 16, 256
# bytes of a share's registers that a part is meant to hold
PART_BYTES = 32 << 20
# rounds after which the registers of all but the last are dropped
HELD_ROUNDS = 4
# rows of registers that are compared at once, and bytes of those that are merged or measured at once
ROWS = 4096
CELLS = 1 << 20
# targets whose edges are laid out together, edges of a target that are laid out so at most, and the
# share of the edges under which those with news are picked out
GROUP = 4096
MOST_EDGES = 256
FEW = 0.1
_POWERS = np.concatenate(([0.0], 0.5 ** np.arange(1, 256)))
_STATE = [("part", pa.int32()), *((n, pa.binary()) for n in ("regs", "sums", "empty", "live", "bits", "more", "fewer"))]
_KINDS = "part int, regs binary, sums binary, empty binary, live binary, bits binary, more binary, fewer binary"


def parts_of(spark, nodes: int, edges: int, width: int) -> int:
    """Two parts a core, more where the registers of a part would take too much memory."""
    cores = spark.sparkContext.defaultParallelism
    return max(-(-nodes * width // PART_BYTES), min(2 * cores, 1 + edges // LEAST_EDGES))


def hashed(values: np.ndarray, lg_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Register and rank that Spark's sketch functions give each long: 128 bits of MurmurHash3."""
    u, seed = np.uint64, np.uint64(9001)
    turned = lambda x, n: (x << u(n)) | (x >> u(64 - n))

    def mixed(x):
        x = (x ^ (x >> u(33))) * u(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> u(33))) * u(0xC4CEB9FE1A85EC53)
        return x ^ (x >> u(33))

    one = turned(values.view(u) * u(0x87C37B91114253D5), 31) * u(0x4CF5AD432745937F)
    two = np.full(len(values), seed ^ u(8))
    one = one ^ seed ^ u(8)
    one = one + two
    two = two + one
    one, two = mixed(one), mixed(two)
    one = one + two
    two = two + one
    # leading zeros, by halves that a double holds exactly
    high = two >> u(32)
    zeros = np.where(high > 0, 32 - np.frexp(high.astype(np.float64))[1], 64 - np.frexp((two & u(0xFFFFFFFF)).astype(np.float64))[1])
    return (one & u((1 << lg_k) - 1)).astype(np.int64), (np.minimum(zeros, 62) + 1).astype(np.uint8)


def headers(empty: np.ndarray, sums: np.ndarray, lg_k: int) -> pa.Array:
    """Of sketches with so many empty registers, and such a sum of 2^-rank over the others, all that
    Spark's estimate reads: the header of a merged sketch of 8-bit registers."""
    kind = np.dtype([("fixed", "u1", 8), ("hip", "<f8"), ("sum", "<f8"), ("rest", "<f8"), ("empty", "<i4"), ("aux", "<i4")])
    rows = np.zeros(len(empty), kind)
    rows["fixed"] = [10, 1, 7, lg_k, 0, 16, 0, 10]
    rows["sum"], rows["empty"] = sums + empty, empty
    ends = np.arange(len(rows) + 1, dtype=np.int32) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def merged(out: np.ndarray, told: np.ndarray, takes: np.ndarray, starts: np.ndarray, into: np.ndarray) -> None:
    """Rows ``into`` of ``out`` take the maxima over their edges, whose rows of ``told`` are ``takes``."""
    lengths = np.diff(np.append(starts, len(takes)))
    order = np.argsort(-lengths, kind="stable")
    some = max(1, CELLS // told.shape[1])
    for lo in range(0, len(order), some):
        at = order[lo : lo + some]
        begin, length = starts[at], lengths[at]
        best = told.take(takes[begin], axis=0)
        k, left = 1, len(at)
        while (left := int(np.searchsorted(-length[:left], -k))) > 16:
            np.maximum(best[:left], told.take(takes[begin[:left] + k], axis=0), out=best[:left])
            k += 1
        for i in range(left):  # long rows are few
            for a in range(begin[i] + k, begin[i] + length[i], some):
                np.maximum(best[i], told.take(takes[a : min(a + some, begin[i] + length[i])], axis=0).max(0), out=best[i])
        out[into[at]] = np.maximum(out[into[at]], best)


def diagonals(into: np.ndarray, starts: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets by falling number of edges, and in groups of ``GROUP`` of them the first sources of all,
    then the second ones, and so on; ``runs`` tells how many, a 0 ends a group."""
    lengths = np.diff(np.append(starts, len(sources)))
    order = np.argsort(-lengths, kind="stable")
    runs, at = [], []
    for lo in range(0, len(order), GROUP):
        some = order[lo : lo + GROUP]
        begin, length = starts[some], lengths[some]
        run = np.searchsorted(-length, -np.arange(length[0]))
        runs += [run, [0]]
        at += [begin[:left] + k for k, left in enumerate(run.tolist())]
    flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int32)
    return into[order], flat(runs).astype(np.int32), sources[flat(at)]


def merged_by_diagonals(out: np.ndarray, told: np.ndarray, into: np.ndarray, runs: np.ndarray, sources: np.ndarray) -> None:
    """As ``merged``, of the edges as ``diagonals`` lays them out."""
    best, lo, at = None, 0, 0
    for left in runs.tolist():
        if best is None:
            best = told.take(sources[at : at + left], axis=0)
        elif left:
            np.maximum(best[:left], told.take(sources[at : at + left], axis=0), out=best[:left])
        else:
            some = into[lo : lo + len(best)]
            out[some] = np.maximum(out.take(some, axis=0), best, out=best)
            best, lo = None, lo + len(best)
        at += left


def edges_of(into: np.ndarray, runs: np.ndarray, sources: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, where their edges begin, and the sources, of the edges of diagonals that are ``kept``."""
    ends = np.cumsum(runs)
    at = np.flatnonzero(kept)
    run = np.searchsorted(ends, at, side="right")
    target = at - (ends - runs)[run] + GROUP * np.cumsum(runs == 0)[run]
    order = np.argsort(target, kind="stable")
    target, starts = np.unique(target[order], return_index=True)
    return into[target], starts, sources[at[order]]


def _kept(into: np.ndarray, starts: np.ndarray, takes: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, where their edges begin, and the edges, of the edges that are ``kept``."""
    before = np.concatenate(([0], np.cumsum(kept)))
    begin, end = before[starts], before[np.append(starts[1:], len(takes))]
    some = end > begin
    return into[some], begin[some], takes[kept]


def _packed_changes(count: int, live: np.ndarray, more: np.ndarray, fewer: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Which of ``count`` rows changed, as bits, and by how much, compressed: they are shuffled to their part."""
    bits = np.zeros(count, bool)
    bits[live] = True
    small = fewer.astype(np.uint16)
    return tuple(pa.compress(c.tobytes(), "zstd", asbytes=True) if len(live) else b"" for c in (np.packbits(bits), more, small))


def _unpacked_changes(count: int, live: bytes, more: bytes, fewer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    opened = lambda c, size: pa.decompress(c, size, "zstd", asbytes=True)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(opened(live, -(-count // 8)), np.uint8), count=count))
    return at, np.frombuffer(opened(more, 8 * len(at))), np.frombuffer(opened(fewer, 2 * len(at)), np.uint16)


def _measured(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of powers and number of empty registers of each row."""
    sums, empty = np.empty(len(regs)), np.empty(len(regs), np.int32)
    step = max(1, CELLS // regs.shape[1])
    for lo in range(0, len(regs), step):
        some = regs[lo : lo + step]
        sums[lo : lo + step] = _POWERS[some].sum(1)
        empty[lo : lo + step] = some.shape[1] - np.count_nonzero(some, axis=1)
    return sums, empty


def _batch(part: int, *cells: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int32()), *(pa.array([memoryview(np.ascontiguousarray(c)).cast("B") if c.size else b""], pa.binary()) for c in cells)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(_STATE))


LAID = ["into", "runs", "sources", "hubs", "hub_starts", "hub_sources"]


def _rows(batches: Iterator[pa.RecordBatch], **kinds: type) -> Iterator[tuple[dict, list]]:
    """Of each row its plain cells and, in the order of ``kinds``, its vectors (None for null)."""
    for batch in batches:
        at = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            plain = {n: c[i].as_py() for n, c in at.items() if n not in kinds}
            yield plain, [None if (b := at[n][i].as_buffer()) is None else np.frombuffer(b, k) for n, k in kinds.items()]


def _hashes(key: tuple, rows: pa.Table) -> pa.Table:
    """The hashes of a part's nodes, in the order of their ids."""
    ids, hashes = (rows.column(c).to_numpy() for c in ("id", "hash"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "hashes": [hashes[np.argsort(ids)].tobytes()]})


def _started(hashes: DataFrame, lg_k: int, low: int, width: int) -> DataFrame:
    """Each node's own register, if it is one of the share."""

    def run(batches):
        for row, (values,) in _rows(batches, hashes=np.int64):
            register, rank = hashed(values, lg_k)
            own = np.flatnonzero((register >= low) & (register < low + width)).astype(np.int32)
            regs = np.zeros((len(values), width), np.uint8)
            regs[own, register[own] - low] = rank[own]
            yield _batch(row["part"], regs, *_measured(regs), own, *[np.empty(0, np.uint8)] * 3)

    return hashes.mapInArrow(run, _KINDS)


def _told(net: Blocks, state: DataFrame, width: int) -> DataFrame:
    """part, got: the maxima over each node's neighbours, of parts that are told something."""

    def tell(batches):
        kinds = {"regs": np.uint8, "live": np.int32, "others": np.int32, "lengths": np.int64, "places": np.int32}
        for row, (regs, live, others, lengths, places) in _rows(batches, **kinds):
            if not len(live):
                continue
            regs = regs.reshape(-1, width)
            changed = np.zeros(len(regs), bool)
            changed[live] = True
            ends = np.cumsum(lengths)
            for other, a, b in zip(others.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                which = np.flatnonzero(changed[places[a:b]]).astype(np.int32)
                if len(which):
                    told = regs[places[a:b][which]]
                    cells = [pa.array([memoryview(c).cast("B")], pa.binary()) for c in (which, told)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (other, row["part"])] + cells, ["part", "other", "which", "told"])

    def take(batches):
        got: dict[int, np.ndarray] = {}
        kinds = {"into": np.int32, "starts": np.int32, "takes": np.int32, "which": np.int32, "told": np.uint8}
        for row, (into, starts, takes, which, told) in _rows(batches, **kinds):
            if row["part"] not in got:
                got[row["part"]] = np.zeros((row["n"], width), np.uint8)
            # edges whose source is told, and where those of each target begin now
            at = np.full(int(takes.max()) + 1, -1, np.int32)
            at[which] = np.arange(len(which), dtype=np.int32)
            takes = at[takes]
            into, starts, takes = _kept(into, starts, takes, takes >= 0)
            merged(got[row["part"]], told.reshape(-1, width), takes, starts, into)
        for part, rows in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([memoryview(rows).cast("B")], pa.binary())], ["part", "got"])

    given = state.select("part", "regs", "live")
    sent = net.routes.join(given.hint("shuffle_hash"), "part").select("part", "regs", "live", "others", "lengths", "places")
    sent = sent.mapInArrow(tell, "part int, other int, which binary, told binary").alias("t")
    # only the part is a key, so that blocks stay where they lie; they are the side that is hashed
    same = (F.col("b.part") == F.col("t.part")) & (F.col("b.other") - F.col("t.other") == 0)
    met = sent.join(net.blocks.alias("b").hint("shuffle_hash"), same).select("b.part", "n", "into", "starts", "takes", "which", "told")
    return met.mapInArrow(take, "part int, got binary")


def _next(net: Blocks, state: DataFrame, width: int) -> Kept:
    """The state after one more step: registers, what they measure, which rows changed and by how much."""

    def run(batches):
        kinds = {"regs": np.uint8, "sums": np.float64, "empty": np.int32, "got": np.uint8}
        for row, (regs, sums, empty, got) in _rows(batches, **kinds):
            regs, live = regs.reshape(-1, width), np.empty(0, np.int32)
            more, fewer = np.empty(0), live
            if got is not None:
                new = np.maximum(regs, got.reshape(-1, width))
                live = np.flatnonzero((new != regs).any(1)).astype(np.int32)
                now, left = _measured(new[live])
                more, fewer = now - sums[live], empty[live] - left
                regs, sums, empty = new, sums.copy(), empty.copy()
                sums[live], empty[live] = now, left
            changed = [np.frombuffer(c, np.uint8) for c in _packed_changes(len(regs), live, more, fewer)]
            yield _batch(row["part"], regs, sums, empty, live, *changed)

    held = state.select("part", "regs", "sums", "empty").join(_told(net, state, width), "part", "left")
    return Kept(held.mapInArrow(run, _KINDS), F.sum(F.octet_length("live")).alias("live"), codec="zstd")


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """The ids and sizes of a part and round as vectors."""
    cells = [pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("id", "size")]
    return pa.Table.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + cells, ["part", "round", "exact", "size"])


def shared_uri(spark, path: str) -> str | None:
    """``path`` as a URI that Arrow opens, None if it is of a kind that Arrow lacks."""
    from pyarrow import fs

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    uri = re.sub("^file:/+", "file:///", uri)
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return uri


def _read(uri: str) -> Iterator[dict]:
    """The rows of a table in the shared folder, one after the other; binary cells as buffers."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, root = fs.FileSystem.from_uri(uri)
    files = (f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    for path in sorted(files):
        with store.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                for i in range(batch.num_rows):
                    yield {n: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _sources(net: Blocks, first: dict[int, int]) -> DataFrame:
    """The blocks with places among all nodes (``first``: that of each part's first node): diagonals of
    the targets with few edges, and of the others where their edges begin."""

    def tell(batches):
        for row, (others, lengths, places) in _rows(batches, others=np.int32, lengths=np.int64, places=np.int32):
            ends = np.cumsum(lengths)
            for other, a, b in zip(others.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                cells = [pa.array([x], pa.int32()) for x in (other, row["part"])]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([memoryview(places[a:b]).cast("B")], pa.binary())], ["part", "other", "tells"])

    def place(batches):
        for row, (into, starts, takes, tells) in _rows(batches, into=np.int32, starts=np.int32, takes=np.int32, tells=np.int32):
            into, sources = into + np.int32(first[row["part"]]), tells[takes] + np.int32(first[row["other"]])
            lengths = np.diff(np.append(starts, len(sources)))
            many = np.repeat(lengths > MOST_EDGES, lengths)
            few, hubs = diagonals(*_kept(into, starts, sources, ~many)), _kept(into, starts, sources, many)
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in (*few, *hubs)], LAID)

    told = net.routes.select("part", "others", "lengths", "places").mapInArrow(tell, "part int, other int, tells binary").alias("t")
    same = (F.col("b.part") == F.col("t.part")) & (F.col("b.other") - F.col("t.other") == 0)
    met = told.join(net.blocks.alias("b").hint("shuffle_hash"), same).select("b.part", "b.other", "into", "starts", "takes", "tells")
    return met.mapInArrow(place, ", ".join(f"{c} binary" for c in LAID))


def _through(hashes: str, blocks: str, parts: list[tuple[int, int, int]], lg_k: int, low: int, width: int) -> Iterator[pa.RecordBatch]:
    """The changes of a slice of all nodes' registers in all rounds. ``parts``: name, first node and number of nodes."""
    count = sum(n for *_, n in parts)
    begin = {part: first for part, first, _ in parts}
    regs, live = np.zeros((count, width), np.uint8), np.zeros(count, bool)
    for row in _read(hashes):
        register, rank = hashed(np.frombuffer(row["hashes"], np.int64), lg_k)
        own = np.flatnonzero((register >= low) & (register < low + width))
        regs[begin[row["part"]] + own, register[own] - low] = rank[own]
        live[begin[row["part"]] + own] = True
    sums, empty = _measured(regs)
    new, distance = regs.copy(), 0
    while live.any():
        distance += 1
        for row in _read(blocks):
            into, runs, sources, hubs, starts, takes = (np.frombuffer(row[c], np.int32) for c in LAID)
            news, hub_news = live.take(sources), live.take(takes)
            if np.count_nonzero(news) < FEW * len(news):
                some, begin, few = edges_of(into, runs, sources, news)
                merged(new, regs, few, begin, some)
            else:
                merged_by_diagonals(new, regs, into, runs, sources)
            if hub_news.any():
                some, begin, few = _kept(hubs, starts, takes, hub_news)
                merged(new, regs, few, begin, some)
        live[:] = False
        for part, first, n in parts:
            at = np.concatenate([lo + np.flatnonzero((new[a:b] != regs[a:b]).any(1)) for lo in range(0, n, ROWS) for a, b in [(first + lo, first + min(lo + ROWS, n))]])
            if len(at):
                now, left = _measured(new[first + at])
                cells = _packed_changes(n, at, now - sums[first + at], empty[first + at] - left)
                sums[first + at], empty[first + at], live[first + at] = now, left, True
                regs[first + at] = new[first + at]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (part, distance)] + [pa.array([c], pa.binary()) for c in cells], ["part", "round", "live", "more", "fewer"])


class Changes:
    """By part and round, what the rounds changed; ``drop`` deletes it. ``shares`` and ``share_bytes`` bound
    what a share of the registers, or a task that takes all nodes, may hold."""

    def __init__(self, net: Blocks, lg_k: int, shares: int, share_bytes: int):
        self.net, self.lg_k, self.kept = net, lg_k, []
        spark, width = net.spark, (1 << lg_k) // max(1, 2 * net.spark.sparkContext.defaultParallelism)
        width = min(MOST_WIDTH, 1 << lg_k, 1 << max(width, LEAST_WIDTH).bit_length() - 1)
        while width >= LEAST_WIDTH and 2 * net.count * width > share_bytes:
            width //= 2
        # a table of one row per part tells whether Arrow opens the shared folder
        hashes = net.nodes.select("id", F.xxhash64("node").alias("hash"), net.part_of("id").alias("part"))
        self.hashes = Kept(hashes.groupBy("part").applyInArrow(_hashes, "part int, hashes binary"), F.count(F.lit(1)).alias("n"))
        if net.count and width >= LEAST_WIDTH and shared_uri(spark, self.hashes.path):
            self._alone(width)
        else:
            self._together(shares)
        self.rows = spark.read.schema(self.kept[0].rows.schema).parquet(*[k.path for k in self.kept])

    def _alone(self, width: int) -> None:
        """A task takes a slice of the registers of all nodes through all rounds."""
        spark, lg_k, first, parts = self.net.spark, self.lg_k, 0, []
        for part, n in sorted(self.hashes.rows.select("part", F.octet_length("hashes") / 8).collect()):
            parts.append((part, first, int(n)))
            first += int(n)
        blocks = Kept(_sources(self.net, {p: f for p, f, _ in parts}), F.count(F.lit(1)).alias("n"), codec="none")
        places = [shared_uri(spark, k.path) for k in (self.hashes, blocks)]

        def run(batches):
            for batch in batches:
                for low in batch.column(0).to_pylist():
                    yield from _through(*places, parts, lg_k, low, width)

        slices = spark.range(0, 1 << lg_k, width, (1 << lg_k) // width)
        changed = slices.mapInArrow(run, "part int, round int, live binary, more binary, fewer binary")
        self.kept.append(Kept(changed, F.count(F.lit(1)).alias("n"), codec="zstd"))
        blocks.drop()

    def _together(self, shares: int) -> None:
        """Shares of the registers one after the other; all tasks work on a round of a share."""
        net, lg_k, width = self.net, self.lg_k, (1 << self.lg_k) // shares
        for share in range(shares):
            state, held, distance = _started(self.hashes.rows, lg_k, share * width, width), [], 0
            while True:
                now, distance = _next(net, state, width), distance + 1
                held.append((distance, now))
                state = now.rows
                done = not now.told["live"]
                if done or len(held) > HELD_ROUNDS:
                    self._keep(held)
                    held = [] if done else held[-1:]
                if done:
                    break
        self.rows = net.spark.read.schema(self.kept[0].rows.schema).parquet(*[k.path for k in self.kept])

    def _keep(self, held: list[tuple[int, Kept]]) -> None:
        """Changes of the rounds not kept yet; registers go, but for the last round's."""
        new = [k.rows.select("part", F.lit(d).alias("round"), F.col("bits").alias("live"), "more", "fewer") for d, k in held if not getattr(k, "counted", False)]
        whole = new[0]
        for rows in new[1:]:
            whole = whole.unionByName(rows)
        self.kept.append(Kept(whole.where(F.octet_length("live") > 0), F.count(F.lit(1)).alias("n"), codec="zstd"))
        more = held[-1][1].told["live"]
        for _, k in held[: -1 if more else None]:
            k.drop()
        held[-1][1].counted = True

    def drop(self) -> None:
        for k in (self.hashes, *self.kept):
            k.drop()

    def _estimated(self, counted: DataFrame | None) -> DataFrame:
        """part, round, at, size, estimate: by part in order of rounds, first in round 0 the ids and degrees of its nodes,
        then by place the sizes that ``counted`` (id, round, size; -1 for no longer known) tells, and estimates of the others that changed."""
        net, lg_k = self.net, self.lg_k
        rows = net.vectors.join(self.hashes.rows, "part").select("part", F.lit(0).alias("round"), "ids", "degrees", "hashes")
        rows = rows.unionByName(self.rows, allowMissingColumns=True)
        if counted is not None:
            packed = counted.withColumn("part", net.part_of("id")).groupBy("part", "round").applyInArrow(_packed, "part int, round int, exact binary, size binary")
            rows = rows.unionByName(packed, allowMissingColumns=True)
        else:
            rows = rows.withColumns({c: F.lit(None).cast("binary") for c in ("exact", "size")})
        rows = rows.select("part", "round", "ids", "degrees", "hashes", "live", "more", "fewer", "exact", "size")

        def run(batches):
            kinds = dict.fromkeys(("ids", "degrees", "hashes", "exact", "size"), np.int64) | dict.fromkeys(("live", "more", "fewer"), np.uint8)
            part = None
            for row, (ids, degrees, hashes, exact, sizes, live, more, fewer) in _rows(batches, **kinds):
                if part is not None and (ids is not None or row["round"] != part.round):
                    yield from part.close()
                if ids is not None:
                    part = _Part(row["part"], ids, hashes, lg_k)
                    yield from part.rows(ids, degrees)
                    continue
                part.round = row["round"]
                if live is not None:
                    part.changed(*_unpacked_changes(len(part.ids), *(c.tobytes() for c in (live, more, fewer))))
                else:
                    yield from part.counted(np.searchsorted(part.ids, exact), sizes)
            if part is not None:
                yield from part.close()

        told = rows.repartition(net.buckets, "part").sortWithinPartitions("part", "round", F.col("exact").isNull())
        told = told.mapInArrow(run, "part int, round int, at long, size long, header binary")
        sketch = F.concat("header", F.lit(bytearray(1 << lg_k)))
        return told.select("part", "round", "at", "size", F.when(F.col("header").isNotNull(), F.hll_sketch_estimate(sketch)).alias("estimate"))

    def _walk(self, make, schema: str, counted: DataFrame | None) -> DataFrame:
        """What ``make`` of each part's ids and degrees tells after the sizes and estimates of all rounds."""

        def run(batches):
            now, state, ids, degrees = None, None, [], []
            for batch in batches:
                part, rounds, at, size, estimate = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(rounds) != 0)) + 1
                for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(part)]):
                    if lo == hi:
                        continue
                    if now is not None and part[lo] != now:
                        yield (state or make(np.concatenate(ids), np.concatenate(degrees))).told()
                        state, ids, degrees = None, [], []
                    now = part[lo]
                    if rounds[lo] == 0:
                        ids.append(at[lo:hi])
                        degrees.append(size[lo:hi].astype(np.int64))
                        continue
                    state = state or make(np.concatenate(ids), np.concatenate(degrees))
                    guess = ~np.isnan(estimate[lo:hi].astype(np.float64))
                    places = at[lo:hi]
                    state.sized(int(rounds[lo]), places[~guess], size[lo:hi][~guess].astype(np.int64))
                    state.guessed(int(rounds[lo]), places[guess], estimate[lo:hi][guess].astype(np.int64))
            if now is not None:
                yield (state or make(np.concatenate(ids), np.concatenate(degrees))).told()

        return self._estimated(counted).mapInArrow(run, schema)

    def sizes(self, counted: DataFrame | None) -> DataFrame:
        """id, seen, steps: how many nodes are reached, and the sum of the steps to them."""
        return self._walk(_Sizes, "id long, seen long, steps long", counted)

    def short(self, cut: float) -> DataFrame:
        """id, last: the last round in which a set is estimated at most at ``cut``."""
        return self._walk(lambda ids, degrees: _Short(ids, cut), "id long, last int", None)


class _Part:
    """The nodes of a part, round by round: what their registers measure, and whose size is known."""

    def __init__(self, part, ids, hashes, lg_k):
        self.part, self.ids, self.lg_k, self.round = part, ids, lg_k, 0
        self.sums, self.empty = _POWERS[hashed(hashes, lg_k)[1]], np.full(len(ids), (1 << lg_k) - 1, np.int64)
        self.touched, self.known = np.zeros(len(ids), bool), np.zeros(len(ids), bool)

    def rows(self, at, size=None) -> Iterator[pa.RecordBatch]:
        """Rows with sizes, or else with what estimates need."""
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            n = len(some)
            sizes = pa.nulls(n, pa.int64()) if size is None else pa.array(size[lo : lo + n])
            header = headers(self.empty[some], self.sums[some], self.lg_k) if size is None else pa.nulls(n, pa.binary())
            cells = [pa.array(np.full(n, x, np.int32)) for x in (self.part, self.round)]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(some), sizes, header], ["part", "round", "at", "size", "header"])

    def changed(self, live, more, fewer) -> None:
        self.sums[live] += more
        self.empty[live] -= fewer
        self.touched[live] = True

    def counted(self, at, sizes) -> Iterator[pa.RecordBatch]:
        self.known[at] = sizes >= 0
        self.touched[at[sizes < 0]] = True
        yield from self.rows(at[sizes >= 0], sizes[sizes >= 0])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.round > 1:  # a set within one step is counted by the degree
            yield from self.rows(np.flatnonzero(self.touched & ~self.known))
        self.touched[:] = False


class _Sizes:
    """Sizes of the sets and sums of steps."""

    def __init__(self, ids, degrees):
        self.ids, self.seen, self.steps = ids, degrees + 1, degrees.copy()

    def sized(self, distance, at, sizes) -> None:
        self.steps[at] += distance * (sizes - self.seen[at])
        self.seen[at] = sizes

    def guessed(self, distance, at, sizes) -> None:
        self.sized(distance, at, np.maximum(self.seen[at], sizes))

    def told(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids, self.seen, self.steps)], ["id", "seen", "steps"])


class _Short:
    def __init__(self, ids, cut):
        self.ids, self.cut, self.last = ids, cut, np.full(len(ids), np.iinfo(np.int32).max, np.int32)

    def sized(self, distance, at, sizes) -> None:
        """No sizes are known here."""

    def guessed(self, distance, at, sizes) -> None:
        grown = at[sizes > self.cut]
        self.last[grown] = np.minimum(self.last[grown], distance - 1)

    def told(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.last)], ["id", "last"])


def counted(net: Blocks, adj: DataFrame, changes: Changes) -> DataFrame | None:
    """id, round, size of the sets that have at most ``EXACT`` nodes, from two steps on; -1 where a
    set grows beyond. None where every node has a neighbour, or itself, with more neighbours than that."""
    most = net.gathered(net.negated_degrees(), np.int64, "min")
    near = rows_of(net.vectors.join(most, "part"), {"ids": "long", "degrees": "long", "got": "long"})
    near = cut_lineage(near.where((F.col("degrees") < EXACT) & (-F.col("got") < EXACT)).select(F.col("ids").alias("id"), F.col("degrees").alias("degree")))
    if near.isEmpty():
        return None
    # lists go only to nodes whose registers allow a short set: ten standard errors
    last = changes.short(EXACT * (1 + 10 * 1.04 / np.sqrt(1 << changes.lg_k)))
    near = cut_lineage(near.join(last, "id").where(F.col("last") >= 2))
    ways = adj.select(net.id_of("src").alias("src"), net.id_of("dst").alias("dst"))
    into = Bucketed(ways.join(near.select(F.col("id").alias("dst"), "degree", "last"), "dst"), ["src"], net.buckets)
    try:
        out = []
        tells = into.rows.select("src").union(near.select("id")).distinct()
        sets = ways.join(tells, "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("fresh"))
        sets = sets.select("id", F.array_append("fresh", F.col("id")).alias("fresh"))
        # at two steps the neighbours tell all of theirs, later only what is new
        state = sets.join(near, "id", "left").select("id", "degree", "last", F.col("fresh").alias("members"), "fresh")
        state, distance, held = cut_lineage(state), 2, None
        while True:
            sent = into.rows.where(F.col("last") >= distance).join(state.select(F.col("id").alias("src"), "fresh").hint("shuffle_hash"), "src")
            got = sent.groupBy(F.col("dst").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("fresh"))).alias("got"), F.count(F.lit(1)).alias("n"))
            mine = state.where(F.col("degree").isNotNull()).join(got, "id", "left")
            fresh = F.when(F.col("n") == F.col("degree"), F.array_except("got", "members"))
            size = F.when(F.col("fresh").isNotNull(), F.size("members") + F.size("fresh")).otherwise(EXACT + 1)
            mine = mine.withColumn("fresh", fresh).withColumn("size", size)
            now = Kept(mine.select("id", "degree", "last", F.when(F.col("size") <= EXACT, F.concat("members", "fresh")).alias("members"), "fresh", "size"),
                       F.sum(F.when(F.col("size") <= EXACT, F.size("fresh"))).alias("new"), F.count(F.lit(1)).alias("left"))
            short = F.col("size") <= EXACT
            size = F.when(short, F.col("size")).otherwise(-1).cast("long").alias("size")
            # the first round tells all, later ones what changed
            told = now.rows.where(~short | (F.size("fresh") > 0) | F.lit(distance == 2))
            out.append(cut_lineage(told.select("id", F.lit(distance).alias("round"), size)))
            if held is not None:
                held.drop()
            held, state, distance = now, now.rows.where(short).drop("size"), distance + 1
            if not now.told["new"]:
                held.drop()
                break
    finally:
        into.drop()
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole
