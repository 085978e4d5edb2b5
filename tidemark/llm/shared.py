"""Written tables in the shared folder, Arrow batch bounds, and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import bounded_batches, checkpoint_dir, shuffles_dropped

#: White space between words, as bytes: blank, and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Odd base of the rolling hashes; arithmetic is modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str = "zstd", level: int = 3) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs no replay,
    a partly read table never shows, and Spark knows the size of what it joins."""
    path = shared_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``most`` bytes of text each; a longer text is a piece of its own.

    What a function makes of a piece (hashes, prefix sums, powers) is many times its size, so
    the piece, not the batch, bounds a worker's memory.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


def by_bytes(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs ``[start, end)`` of texts that hold about ``most`` characters each; a longer text is a run of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; the longest asked for is kept."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: 0 for letters of words, 1 for blanks, 2 for ASCII punctuation, which near-copy words leave out.
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
#: A letter's number; A-Z have those of a-z.
_LETTER = np.arange(1, 257, dtype=np.uint64)
_LETTER[65:91] += np.uint64(32)


def word_hashes(column: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and the offsets of the texts among them.

    Words are runs without white space; A-Z count as a-z and ASCII punctuation as nothing, so a
    word of punctuation only is no word, unless ``marks`` keeps it. A null text has none. One pass over the bytes of the
    batch: a word's hash is the difference of prefix sums of ``byte * BASE ** position``, shifted
    to position 0 by the inverse power.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(raw) == 0:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    kind = _KIND[raw]
    left_out = np.flatnonzero(kind == 2) if not marks else ()
    if len(left_out):
        keep = kind != 2
        raw, kind, offsets = raw[keep], kind[keep], offsets - np.searchsorted(left_out, offsets)
    solid = np.zeros(len(raw) + 2, bool)
    np.not_equal(kind, 1, out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    # a text's end inside a run of letters ends one word and begins the next
    border = np.unique(offsets[1:-1])
    run = np.searchsorted(starts, border, side="right") - 1
    inside = (run >= 0) & (starts[run] < border) & (border < ends[run])
    if inside.any():
        starts, ends = np.insert(starts, run[inside] + 1, border[inside]), np.insert(ends, run[inside], border[inside])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * powers(len(raw), BASE), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * powers(len(raw), pow(BASE, -1, 2**64))[starts])
    return words, np.searchsorted(starts, offsets)
