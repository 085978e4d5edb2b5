"""A graph as blocks of edges between parts of its nodes, for sums and minima over neighbours.

Nodes lie in parts by a hash, and a value of all nodes of a part is one vector. A block holds the
edges from one part to another; it is laid out once, with the places of its nodes in both
vectors. In a round a part tells each other part the values of those of its nodes that have
neighbours there, each once and in the order of the block, so bare numbers are shuffled and no edge
or name moves. A hub is told at most once to a part, and its own edges lie in many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import Bucketed, Kept, cut_lineage

# edges that a part is meant to hold, and those below which a graph is not cut further
PART_EDGES = 4_000_000
LEAST_EDGES = 100_000
# bytes of an Arrow batch of vectors and blocks
BATCH_BYTES = 16 << 20
MERGES = {"sum": (np.add, 0), "min": (np.minimum, np.iinfo(np.int64).max)}


def mapped(df: DataFrame, make: Callable[..., dict], schema: str) -> DataFrame:
    """``make(**columns)`` of every row, binary columns as bytes."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    named = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([make(**{n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)})], named)

    return df.mapInArrow(run, schema)


def rows_of(vectors: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of vectors: the columns with their Spark types, one row per node."""
    kinds = {"long": np.int64, "double": np.float64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = [np.frombuffer(batch.column(n)[i].as_buffer(), kinds[k]) for n, k in columns.items()]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], list(columns))

    return vectors.select(*columns).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in columns.items()))


def _vector(key: tuple, rows: pa.Table) -> pa.Table:
    """The ids of a part in ascending order, with their degrees."""
    ids, degrees = (rows.column(c).to_numpy() for c in ("id", "degree"))
    order = np.argsort(ids)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "degrees": [degrees[order].tobytes()]})


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """Both directions of the edges between two parts: by part told, the targets, where the edges
    of each begin, the sources, and each edge's source."""
    a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
    part, other = (k.as_py() for k in key)
    ways = [(part, other, a, b), (other, part, b, a)] if part != other else [(part, part, np.concatenate((a, b)), np.concatenate((b, a)))]
    out = []
    for to, of, targets, sources in ways:
        order = np.argsort(targets)
        into, starts = np.unique(targets[order], return_index=True)
        tells, takes = np.unique(sources[order], return_inverse=True)
        cells = {"into": into, "starts": starts.astype(np.int32), "tells": tells, "takes": takes.astype(np.int32)}
        out.append({"part": to, "other": of} | {n: c.tobytes() for n, c in cells.items()})
    kinds = [("part", pa.int32()), ("other", pa.int32()), *((n, pa.binary()) for n in ("into", "starts", "tells", "takes"))]
    return pa.Table.from_pylist(out, pa.schema(kinds))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, dict]]:
    """Of rows sorted by part, after each part's own ids: part, its length, other part, places of the row's ids."""
    held = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
            ids = np.frombuffer(row["ids"], np.int64)
            if row["other"] < 0:
                held = ids
            else:
                yield row["part"], len(held), row["other"], np.searchsorted(held, ids).astype(np.int32), row


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per part: the parts it tells, how many values each, and their places."""
    now, others, places = None, [], []

    def row() -> pa.RecordBatch:
        cells = {"others": np.array(others, np.int32), "lengths": np.array([len(p) for p in places], np.int64), "places": np.concatenate(places)}
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([c.tobytes()]) for c in cells.values())], ["part", *cells])

    for part, _, other, at, _ in _located(batches):
        if part != now and others:
            yield row()
            others, places = [], []
        now = part
        others.append(other)
        places.append(at)
    if others:
        yield row()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, n, other, at, row in _located(batches):
        ints = [pa.array([x], pa.int32()) for x in (part, other, n)]
        yield pa.RecordBatch.from_arrays([*ints, *(pa.array([c]) for c in (at.tobytes(), row["starts"], row["takes"]))], ["part", "other", "n", "into", "starts", "takes"])


class Blocks:
    """The blocks of ``adj`` (both directions of each edge), and per node its id and part.

    ``vectors`` has a row per part: the ids and degrees of its nodes. ``with Blocks(adj, nodes) as
    net`` drops the blocks at the end and bounds Arrow batches until then. ``parts_of(nodes, edges)``
    gives another number of parts; these get names that lie in buckets of their own.
    """

    def __init__(self, adj: DataFrame, nodes: DataFrame, part_edges: int = PART_EDGES, parts_of: Callable[[int, int], int] | None = None):
        self.spark = spark = adj.sparkSession
        size = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("m")).first()
        self.count, edges = size["n"], size["m"] or 0
        session = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.parts = parts = parts_of(self.count, edges) if parts_of else max(-(-edges // part_edges), min(session, 1 + edges // LEAST_EDGES))
        self.buckets = max(session, parts)
        self._limits = {f"spark.sql.execution.arrow.{k}": v for k, v in {"maxBytesPerBatch": str(BATCH_BYTES), "maxRecordsPerBatch": "100000"}.items()}
        self._before = {k: spark.conf.get(k, None) for k in self._limits}
        for k, v in self._limits.items():
            spark.conf.set(k, v)
        # ids are hashes, under the first seed that tells all nodes apart
        seed, id_of = 0, lambda c: F.xxhash64(F.lit(seed), F.col(c))
        while nodes.select(id_of("node").alias("id")).distinct().count() < self.count:
            seed += 1
        if parts_of:
            bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(self.buckets))
            firsts = spark.range(40 * self.buckets).groupBy(bucket.alias("b")).agg(F.min("id").alias("id")).orderBy("b").limit(parts).collect()
            # more names than buckets that were met: the rest share one
            names = [r["id"] for r in firsts] + [40 * self.buckets + i for i in range(parts - len(firsts))]
            named = F.array(*[F.lit(n).cast("int") for n in names])
            part_of = lambda c: F.get(named, F.pmod(F.col(c), F.lit(parts)).cast("int"))
        else:
            part_of = lambda c: F.pmod(F.col(c), F.lit(parts)).cast("int")
        self.id_of, self.part_of = id_of, part_of
        self.nodes = nodes.select("node", id_of("node").alias("id"))
        ids = nodes.select(id_of("node").alias("id"), "degree").withColumn("part", part_of("id"))
        self.vectors = cut_lineage(ids.groupBy("part").applyInArrow(_vector, "part int, ids binary, degrees binary"))
        # an edge goes once to the block of its two parts, which lays out both directions
        pairs = adj.where(F.col("src") < F.col("dst")).select(id_of("src").alias("x"), id_of("dst").alias("y"))
        ends = [F.struct(part_of(c).alias("part"), F.col(c).alias("id")) for c in "xy"]
        pairs = pairs.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
        pairs = pairs.select(F.col("a.part").alias("part"), F.col("b.part").alias("other"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        cells = Kept(
            pairs.repartition(self.buckets, "part", "other").groupBy("part", "other")
            .applyInArrow(_block, "part int, other int, into binary, starts binary, tells binary, takes binary"),
            F.count(F.lit(1)).alias("n"),
        )
        own = self.vectors.select("part", F.lit(-1).alias("other"), "ids")
        told = cells.rows.select(F.col("other").alias("part"), F.col("part").alias("other"), F.col("tells").alias("ids"))
        met = cells.rows.select("part", "other", F.col("into").alias("ids"), "starts", "takes")
        routes = self._by_part(own.unionByName(told)).mapInArrow(_routes, "part int, others binary, lengths binary, places binary")
        blocks = self._by_part(own.unionByName(met, allowMissingColumns=True)).mapInArrow(
            _blocks, "part int, other int, n int, into binary, starts binary, takes binary"
        )
        self._routes = Bucketed(routes, ["part"], self.buckets)
        self._blocks = Bucketed(blocks, ["part"], self.buckets)
        cells.drop()

    @property
    def routes(self) -> DataFrame:
        """part, others, lengths, places: the parts each part tells, how many rows, and their places."""
        return self._routes.rows

    @property
    def blocks(self) -> DataFrame:
        """part, other, n, into, starts, takes: the edges into a part from another."""
        return self._blocks.rows

    def negated_degrees(self) -> DataFrame:
        """part and the vector ``given``."""
        return mapped(self.vectors.select("part", "degrees"), lambda part, degrees: {"part": part, "given": (-np.frombuffer(degrees, np.int64)).tobytes()}, "part int, given binary")

    def _by_part(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "part").sortWithinPartitions("part", "other")

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *error) -> None:
        self._routes.drop()
        self._blocks.drop()
        for k, v in self._before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def gathered(self, given: DataFrame, kind: type, merge: str) -> DataFrame:
        """part, got: the merged values of each node's neighbours; ``given`` has part and the vector ``given``."""
        ufunc, first = MERGES[merge]

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part, values = batch.column(0)[i], np.frombuffer(batch.column(1)[i].as_buffer(), kind)
                    others, lengths, places = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.int32), (3, np.int64), (4, np.int32)))
                    ends = np.cumsum(lengths)
                    for other, a, b in zip(others.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array([other], pa.int32()), pa.array([part.as_py()], pa.int32()), pa.array([values[places[a:b]].tobytes()])], ["part", "other", "told"])

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.column(0)[i].as_py()
                    into, starts, takes = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in (2, 3, 4))
                    told = np.frombuffer(batch.column(5)[i].as_buffer(), kind)
                    if part not in sums:
                        sums[part] = np.full(batch.column(1)[i].as_py(), first, kind)
                    sums[part][into] = ufunc(sums[part][into], ufunc.reduceat(told[takes], starts))
            for part, got in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([got.tobytes()])], ["part", "got"])

        told = self._routes.rows.join(given.hint("shuffle_hash"), "part").select("part", "given", "others", "lengths", "places")
        sent = told.mapInArrow(tell, "part int, other int, told binary").alias("t").hint("shuffle_hash")
        # only the part is a key, so that all of a part's blocks meet where they lie
        same = (F.col("b.part") == F.col("t.part")) & (F.col("b.other") - F.col("t.other") == 0)
        met = self._blocks.rows.alias("b").join(sent, same).select("b.part", "n", "into", "starts", "takes", "told")
        return met.mapInArrow(take, "part int, got binary")

    def kept(self, state: DataFrame, make: Callable[..., dict], schema: str, *metrics: Column) -> Kept:
        """``make`` of every row of ``state``, written."""
        return Kept(mapped(state, make, schema), *metrics)

    def named(self, vectors: DataFrame, name: str, kind: str) -> DataFrame:
        """node and its value, from part and the vector ``name``."""
        rows = rows_of(self.vectors.join(vectors, "part"), {"ids": "long", name: kind})
        return self.nodes.join(rows, F.col("id") == F.col("ids")).select("node", name)
