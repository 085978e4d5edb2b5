"""Token ids in training order: a keyed permutation of global sequence numbers, written as fixed-stride shards.

Texts become ids with an end mark behind each; the ids of a task's texts are one stream, cut
into sequences of ``length`` ids. Sequences are written once with their task and number, so the
numbers are stable however often they are read; counts of tasks give each sequence a dense
global number. A keyed Feistel network over the next even power of two, walked on while it
leaves the range, permutes the numbers to slots. Slots are range-partitioned by shard, sorted,
and each shard is one file in which slot s stands at ``s % per_shard * stride``.

Defined results: texts without tokens (null or empty) take no place; the last sequence of a task
is filled up with the end mark and tells its own length; repeated rows are written each; null
ids are told as null; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.llm.shared import bounded_batches, mix, shared_path, written
from tidemark.llm.token_counts import BLANK, PieceEncoder

WIDTH = np.dtype("<u2")
#: Starts of so many tasks at most (two numbers each) are broadcast.
MANY_TASKS = 1_000_000
#: Shards that a task writes, one after the other.
SHARDS_OF_A_TASK = 16


class FlatIds:
    """Ids of texts: every part met has a number, and its ids stand in one array, from which a batch is gathered at once."""

    def __init__(self, encoder: PieceEncoder) -> None:
        self.encoder = encoder
        self.forget()

    def forget(self) -> None:
        """Only the end mark, number 0, is known."""
        self.numbers: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.array([self.encoder.model.eos_id()], WIDTH), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.chars = 0

    def learn(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts; those not yet known are encoded in one call."""
        if self.chars > self.encoder.most:
            self.forget()
        new = [p for p in dict.fromkeys(parts) if p not in self.numbers]
        if new:
            encoder = self.encoder
            held = [i if p or not encoder.cuts else encoder.blank for p, i in zip(new, encoder.model.encode(new, num_threads=1), strict=True)]
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            self.numbers.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(held), WIDTH, int(sizes.sum()))))
            self.chars += sum(map(len, new))
        return np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of the texts, and how many each has.

        Texts without runs of blanks, most of them, are split and their parts told apart by
        Arrow, so only distinct parts become Python strings; the others go one by one.
        """
        texts = pc.replace_substring(texts, BLANK, " ")
        plain = pc.invert(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")))
        plain = pc.and_(plain, pc.not_equal(texts, "")).to_numpy(zero_copy_only=False) & self.encoder.cuts
        cut = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        known = cut.flatten().dictionary_encode()
        odd = self.encoder.cut(texts.filter(pa.array(~plain)).to_pylist())
        # one call, so that what is forgotten is forgotten for both
        numbers = self.learn([*known.dictionary.to_pylist(), *chain.from_iterable(odd)])
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        counts[~plain] = np.fromiter(map(len, odd), np.int64, len(odd))
        out = np.empty(counts.sum(), np.int64)
        of_plain = np.repeat(plain, counts)
        out[of_plain] = numbers[: len(known.dictionary)][known.indices.to_numpy()]
        out[~of_plain] = numbers[len(known.dictionary) :]
        return out, counts

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, an end mark behind each that has any, and how many places each takes."""
        numbers, counts = self.parts(texts)
        ends = np.cumsum(counts + 1)
        number = np.zeros(ends[-1], np.int64)
        place = np.ones(len(number), bool)
        place[ends - 1] = False
        number[place] = numbers
        sizes = self.sizes[number]
        sizes[ends - 1] = 0
        taken = np.add.reduceat(sizes, ends - counts - 1)
        sizes[ends - 1] = taken > 0
        upto = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[number] - (upto - sizes), sizes) + np.arange(upto[-1])], taken + (taken > 0)


def byte_runs(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Runs ``[start, end)`` of texts that hold about ``most`` bytes each."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(upto // most)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    return [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]


def sequences(docs: DataFrame, model: str, length: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 16_000_000) -> DataFrame:
    """part, seq, n_tokens, doc_ids, ids (``length`` two-byte ids) of every sequence."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("part", LongType()), StructField("seq", LongType()), StructField("n_tokens", LongType()), StructField("doc_ids", ArrayType(rows.schema["id"].dataType))])
    schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, part, seq = None, TaskContext.get().partitionId(), 0
        rest, owners, kind, end = np.empty(0, WIDTH), [], None, None

        def told(out: list[tuple]) -> pa.RecordBatch:
            seqs, ns, ids, data = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int64()), pa.array(seqs, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.list_(kind)), pa.array(data, pa.binary())], schema.names)

        for batch in batches:
            flat = flat or FlatIds(PieceEncoder(model))
            end, kind = flat.encoder.model.eos_id(), batch.schema.field(0).type
            names, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for a, b in byte_runs(texts, batch_bytes):
                ids, taken = flat.stream(texts.slice(a, b - a))
                stream, out = np.concatenate((rest, ids)), []
                upto = (len(rest) + np.cumsum(taken)).tolist()
                spans = [(0, len(rest), name) for name in owners] + [(z - n, z, name) for name, n, z in zip(names[a:b], taken.tolist(), upto, strict=True) if n]
                k = 0
                for s in range(0, len(stream) - length + 1, length):
                    while k < len(spans) and spans[k][1] <= s:
                        k += 1
                    inside = []
                    for span in spans[k:]:
                        if span[0] >= s + length:
                            break
                        inside.append(span[2])
                    out.append((seq, length, inside, stream[s : s + length].tobytes()))
                    seq += 1
                cut = len(stream) // length * length
                owners = [span[2] for span in spans if span[1] > cut]
                rest = stream[cut:].copy()
                if out:
                    yield told(out)
        if len(rest):
            full = np.concatenate((rest, np.full(length - len(rest), end, WIDTH)))
            yield told([(seq, len(rest), owners, full.tobytes())])

    return rows.mapInArrow(run, schema)


def feistel(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..size-1: Feistel rounds over 2**(2*half), repeated for what falls outside."""
    if size <= 1:
        return numbers.astype(np.int64)
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << half | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= np.uint64(size)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def slot_of(number: Column, size: int, key: int) -> Column:
    """The slot of a global sequence number among ``size``."""

    @F.pandas_udf("long")
    def slots(n: pd.Series) -> pd.Series:
        return pd.Series(feistel(n.to_numpy(), size, key) if len(n) else [], dtype="int64")

    return slots(number)


def open_folder(uri: str):
    """Arrow's file system of a qualified folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI of the file system that Spark opens it with; an error, before any work, if Arrow cannot open it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = re.sub("^file:/+", "file:///", uri)
    open_folder(uri)
    return uri


def squeezed(ids: Column) -> Column:
    """The bytes compressed one by one, for the shuffle."""

    @F.pandas_udf("binary")
    def squeeze(data: pd.Series) -> pd.Series:
        import zstandard

        return data.map(zstandard.ZstdCompressor(level=3).compress)

    return squeeze(ids)


def numbered(parts: DataFrame, many: int = MANY_TASKS) -> tuple[DataFrame, int]:
    """``parts`` (part, seq, ..) with ``number``, dense over all sequences, and how many there are: one row for each task is summed up."""
    sizes = written(parts.groupBy("part").agg((F.max("seq") + 1).alias("n")), "sizes")
    tasks, total = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    if tasks <= many:
        starts = F.broadcast(starts)
    return parts.join(starts, "part").withColumn("number", F.col("first") + F.col("seq")).drop("first"), total or 0


def write_shards(docs: DataFrame, model: str, folder: str | None = None, length: int = 1024, per_shard: int = 1024, key: int = 20240101, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``folder`` (default: the shared folder) and return their index.

    The index has slot, shard, offset, n_tokens, part, seq, doc_ids of every sequence, and the
    file. ``folder`` is a path or URI as Spark reads it, of a kind that Arrow's file systems open,
    too; the index has it as a URI. A file is
    written beside its place and moved there when whole, so a task that is run again leaves one.
    """
    import zstandard

    spark = docs.sparkSession
    folder = qualified(spark, folder or shared_path(spark, "shards"))
    stride = length * WIDTH.itemsize
    kept = written(sequences(docs, model, length, id_col, text_col), "sequences", level=9)
    placed, total = numbered(kept)
    placed = placed.withColumn("slot", slot_of(F.col("number"), total, key)).withColumn("shard", F.floor(F.col("slot") / per_shard))
    dealt = placed.select("shard", "slot", "n_tokens", "part", "seq", "doc_ids", squeezed(F.col("ids")).alias("ids"))
    # slots are dense, so the ranges of shards are known without a look at the rows
    tasks = max(1, -(-total // (per_shard * SHARDS_OF_A_TASK)))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") / SHARDS_OF_A_TASK).cast("int")).sortWithinPartitions("slot")
    index = StructType([*(f for f in dealt.schema if f.name != "ids"), StructField("offset", LongType())]).add("file", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        store.create_dir(root, recursive=True)
        open_shard, out, at = None, None, ""

        def close() -> None:
            out.close()
            store.move(at, f"{root}/{shard_name(open_shard)}")

        for batch in batches:
            shards, slots = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for shard, data in zip(shards, batch.column(6), strict=True):
                if shard != open_shard:
                    if out:
                        close()
                    open_shard, at = shard, f"{root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(at)
                out.write(unpack(data.as_py()))
            files = pa.array(list(map(shard_name, shards)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(slots % per_shard * stride, pa.int64()), files], index.names)
        if out:
            close()

    return written(dealt.mapInArrow(run, index), "index").withColumn("folder", F.lit(folder))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(folder: str, start: int, count: int, length: int = 1024, per_shard: int = 1024) -> Iterator[np.ndarray]:
    """Sequences ``start`` to ``start + count`` in training order: seeks once, then reads on."""
    store, root = open_folder(folder)
    stride = length * WIDTH.itemsize
    for shard in range(start // per_shard, (start + count - 1) // per_shard + 1 if count else 0):
        first, last = max(start, shard * per_shard), min(start + count, (shard + 1) * per_shard)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as file:
            file.seek((first - shard * per_shard) * stride)
            for _ in range(first, last):
                if len(data := file.read(stride)) < stride:
                    return
                yield np.frombuffer(data, WIDTH)
