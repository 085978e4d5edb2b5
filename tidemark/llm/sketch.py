"""Blocked counting Bloom sketches: counted in every task, added up block by block, sent to all tasks.

A key is two 64-bit hashes: the first gives its block, the second ``PROBES`` cells in it. Tasks
hand on the cells they touched, so what travels follows the keys. The merged sketch is one bit a
cell (set ``least`` times or more), ``CELLS`` cells a key up to ``MOST_BLOCKS`` blocks: 128 MB at
most. More keys than that make more false answers, never lost ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a block of the sketch; a key's cells lie in one block.
BLOCK = 1 << 16
#: Cells for each key, and how many of them a key sets.
CELLS, PROBES = 16, 4
#: Blocks at most: with one bit a cell, the merged sketch is 8 KB a block.
MOST_BLOCKS = 1 << 14
#: Touched cells that a task holds before it hands them on.
HELD = 1 << 22


def places(words: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and cells (one row of ``PROBES`` a key) of keys (two words each)."""
    return (words[:, 0] % np.uint64(blocks)).astype(np.int64), np.ascontiguousarray(words[:, 1]).view("<u2").reshape(-1, PROBES).astype(np.int64)


def sparse_counts(codes: list[np.ndarray]) -> pa.RecordBatch:
    """block, cells, counts of codes ``block * BLOCK + cell``; counts stop at 255."""
    code, count = np.unique(np.concatenate(codes), return_counts=True)
    block, cell, count = code // BLOCK, (code % BLOCK).astype("<u2"), np.minimum(count, 255).astype(np.uint8)
    held, starts = np.unique(block, return_index=True)
    ends = np.append(starts[1:], len(code))
    cells = [cell[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    counts = [count[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], ["block", "cells", "counts"])


def partial_sketches(rows: DataFrame, words: Callable[[pa.RecordBatch], np.ndarray], blocks: int) -> DataFrame:
    """block, cells, counts: what a task's keys touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block, cell = places(words(batch), blocks)
            codes.append((block[:, None] * BLOCK + cell).ravel())
            n += len(codes[-1])
            if n >= HELD:
                yield sparse_counts(codes)
                codes, n = [], 0
        if codes:
            yield sparse_counts(codes)

    return rows.mapInArrow(run, "block long, cells binary, counts binary")


def merged_blocks(partial: DataFrame, told: Callable[[np.ndarray], bytes], kind: type = np.uint8) -> DataFrame:
    """block, held: what ``told`` makes of the counters of a block, all partial sketches added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counter = None, np.zeros(BLOCK, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([told(counter)], pa.binary())], ["block", "held"])

        for batch in batches:
            for block, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, counter = block, np.zeros(BLOCK, np.int64)
                counter[np.frombuffer(cells, "<u2") if cells else slice(None)] += np.frombuffer(counts, kind)
        if now is not None:
            yield row()

    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, held binary")


def counter_blocks(counts: np.ndarray) -> pa.RecordBatch:
    """block, cells, counts of the blocks of a task's counters that hold any; no cells where most are touched. Counts stop at 65535."""
    held = [(b, c) for b, c in enumerate(np.minimum(counts, 65535).astype("<u2").reshape(-1, BLOCK)) if c.any()]
    touched = [np.flatnonzero(c) for _, c in held]
    many = [4 * len(t) > BLOCK for t in touched]
    cells = [b"" if m else t.astype("<u2").tobytes() for t, m in zip(touched, many, strict=True)]
    values = [(c if m else c[t]).tobytes() for (_, c), t, m in zip(held, touched, many, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array(cells, pa.binary()), pa.array(values, pa.binary())], ["block", "cells", "counts"])


class Sketch:
    """The merged sketch of the keys of ``rows``, held by every task: which keys were met ``least`` times."""

    def __init__(self, rows: DataFrame, words: Callable[[pa.RecordBatch], np.ndarray], n: int, least: int) -> None:
        self.blocks = min(MOST_BLOCKS, max(1, -(-n * CELLS // BLOCK)))
        bits = np.zeros((self.blocks, BLOCK // 8), np.uint8)
        told = lambda counter: np.packbits(counter >= least, bitorder="little").tobytes()
        for block, held in merged_blocks(partial_sketches(rows, words, self.blocks), told).collect():
            bits[block] = np.frombuffer(held, np.uint8)
        self.bits = rows.sparkSession.sparkContext.broadcast(bits)

    def met(self, words: np.ndarray) -> np.ndarray:
        """False only for keys that were met less than ``least`` times."""
        if not len(words):
            return np.zeros(0, bool)
        block, cell = places(words, self.blocks)
        return (self.bits.value[block[:, None], cell >> 3] >> (cell & 7) & 1).astype(bool).all(1)
