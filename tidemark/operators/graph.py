"""Graph operators: rounds of joins and grouped sums over an adjacency table.

Algorithms of many rounds lay the edges once into buckets (``Placed``). A round then moves
node rows to the edges and merged sums back; the edges stay where they lie. The edges of a
hub are cut into slices of bounded size, and the hub's row goes to each slice. A round is
one job, whose observed metrics tell when to stop. Other operators join the plain pairs,
where a hub is split by Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.columns import ratio
from tidemark.operators import sketches
from tidemark.operators.blocks import Blocks
from tidemark.session import Bucketed, Kept, cut_lineage

# edges of a node that lie in one slice, and rows that a bucket is meant to hold
SLICE_EDGES = 500_000
BUCKET_EDGES = 4_000_000
# shares of the registers that sketches with large messages are cut into at most, and bytes meant for one
SLOTS = 16
SHARE_BYTES = 1 << 28


class NotConverged(RuntimeError):
    """The rounds allowed were used up; ``rows`` holds the last state reached."""

    def __init__(self, what: str, rounds: int, rows: DataFrame):
        super().__init__(f"{what} did not settle in {rounds} rounds")
        self.rows = rows


def adjacency(edges: DataFrame, parts: int | None = None, single: bool = False) -> DataFrame:
    """Both directions of (src, dst, weight), one row per ordered pair, no loops.

    A pair is merged once, not once a direction. ``parts`` says into how many partitions the
    pairs are dealt where the session's number would give a task too many. ``single`` says that
    no pair occurs twice, in either direction, so that none needs to be merged.
    """
    ends = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    pairs = edges.where(F.col("src") != F.col("dst")).select(*ends, "weight")
    if not single:
        pairs = pairs if parts is None else pairs.repartition(parts, "a", "b")
        pairs = pairs.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    pairs = cut_lineage(pairs)
    ways = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "weight") for x, y in ("ab", "ba")])
    return pairs.select(F.explode(ways).alias("e")).select("e.*")


def nodes_of(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("src").alias("node")).distinct()


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(adj: DataFrame) -> DataFrame:
    """degree / (n - 1); a lone pair of nodes and more."""
    d = degrees(adj)
    others = d.agg((F.count(F.lit(1)) - 1).alias("others")).scalar()
    return d.select("node", "degree", ratio(F.col("degree"), others).alias("centrality"))


class Placed:
    """Edges in buckets of (src, slice), and per node its degree and number of slices.

    ``with Placed(adj) as net`` drops the buckets at the end.
    """

    def __init__(self, adj: DataFrame, slice_edges: int = SLICE_EDGES):
        self.nodes = cut_lineage(
            degrees(adj).withColumn("slices", F.ceil(F.col("degree") / slice_edges).cast("int"))
        )
        size = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("m")).first()
        self.count, edges = size["n"], size["m"] or 0
        parts = int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = buckets = max(parts, -(-edges // BUCKET_EDGES))
        hubs = self.nodes.where(F.col("slices") > 1).select(F.col("node").alias("src"), "slices")
        cut = adj.join(hubs, "src", "left").select(
            "src",
            F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"),
            "dst",
            "weight",
        )
        self._edges = Bucketed(cut, ["src", "slice"], buckets)
        self.edges = self._edges.rows

    def __enter__(self) -> Placed:
        return self

    def __exit__(self, *error) -> None:
        self._edges.drop()

    def along(self, state: DataFrame, *values: Column) -> DataFrame:
        """Values of each node at its edges: (dst, weight, values). ``state`` holds node
        and slices; only its rows are shuffled, and hashed, so no edge is sorted."""
        copies = state.select(
            F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *values
        )
        return self.edges.join(copies.hint("shuffle_hash"), ["src", "slice"]).drop("src", "slice")

    def gathered(self, state: DataFrame, value: Column, merge) -> DataFrame:
        """``state`` with ``got``: the merged values of a node's neighbours. A node's own
        row travels with its messages, so they meet in the grouping and need no join."""
        return self.met(self.along(state, value.alias("got")), state, merge)

    def met(self, sent: DataFrame, state: DataFrame, merge) -> DataFrame:
        """``state`` with ``got``: what was ``sent`` to each of its nodes, merged."""
        own = [c for c in state.columns if c != "node"]
        sent = sent.select(
            F.col("dst").alias("node"), "got", *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in own]
        )
        kind = sent.schema["got"].dataType
        mine = state.select("node", F.lit(None).cast(kind).alias("got"), *own)
        return sent.unionByName(mine).groupBy("node").agg(merge("got").alias("got"), *[F.max(c).alias(c) for c in own])


def pagerank(adj: DataFrame, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Undirected PageRank; on convergence the vector before the last is returned.
    Raises ``NotConverged`` after ``max_iter`` rounds."""
    with Blocks(adj, cut_lineage(degrees(adj))) as net:
        n = max(net.count, 1)
        base = (1 - damping) / n

        def start(part, ids, degrees):
            degree = np.frombuffer(degrees, np.int64)
            return {"part": part, "degrees": degrees, "rank": np.full(len(degree), 1.0 / n).tobytes(), "given": (1.0 / n / degree).tobytes(), "moved": 0.0}

        def step(part, degrees, rank, got):
            new = base + damping * np.frombuffer(got)
            moved = float(np.abs(new - np.frombuffer(rank)).sum())
            return {"part": part, "degrees": degrees, "rank": new.tobytes(), "given": (new / np.frombuffer(degrees, np.int64)).tobytes(), "moved": moved}

        state = "part int, degrees binary, rank binary, given binary, moved double"
        last = net.kept(net.vectors, start, state, F.sum("moved").alias("moved"))
        for _ in range(max_iter):
            got = net.gathered(last.rows.select("part", "given"), np.float64, "sum")
            kept = net.kept(last.rows.select("part", "degrees", "rank").join(got, "part"), step, state, F.sum("moved").alias("moved"))
            if (kept.told["moved"] or 0.0) < tolerance:
                kept.drop()
                return net.named(last.rows.select("part", "rank"), "rank", "double")
            last.drop()
            last = kept
    raise NotConverged("pagerank", max_iter, net.named(last.rows.select("part", "rank"), "rank", "double"))


def eigenvector_centrality(adj: DataFrame, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration with L2 norm; on convergence the vector before the last. Raises
    ``NotConverged`` after ``max_iter`` rounds (a bipartite graph may swing for ever)."""
    with Placed(adj) as net:
        state, last = net.nodes.select("node", "slices", F.lit(1.0).alias("score")), None
        for _ in range(max_iter):
            sums = net.gathered(state, F.col("score"), F.sum).withColumnRenamed("got", "raw")
            kept = Kept(sums, F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
            score = F.col("raw") / (kept.told["norm"] or 1.0)
            # the norm is known only when all sums are: the change is a scan of the nodes
            moved = kept.rows.agg(F.sum(F.abs(score - F.col("score")))).first()[0]
            if (moved or 0.0) < tolerance:
                out = state.select("node", "score")
                kept.drop()
                return out
            if last is not None:
                last.drop()
            state, last = kept.rows.select("node", "slices", score.alias("score")), kept
    raise NotConverged("eigenvector centrality", max_iter, state.select("node", "score"))


def distances(adj: DataFrame, sources: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """Shortest distance from every source (default: all nodes) to what it reaches.

    Relaxation from the frontier only: a round joins the pairs that just got shorter.
    The result of all sources is n rows per source by nature; pass ``sources`` to bound it.
    """
    start = (nodes_of(adj) if sources is None else sources).select(F.col("node").alias("source"))
    cost = F.col("weight") if weighted else F.lit(1.0)
    best = start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"))
    frontier = best
    while True:
        tried = (
            frontier.join(adj.select(F.col("src").alias("node"), "dst", cost.alias("__w")), "node")
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.min(F.col("distance") + F.col("__w")).alias("tried"))
        )
        merged = cut_lineage(
            best.join(tried, ["source", "node"], "full").select(
                "source",
                "node",
                F.least("distance", "tried").alias("distance"),
                (F.col("tried").isNotNull() & (F.col("distance").isNull() | (F.col("tried") < F.col("distance")))).alias("new"),
            )
        )
        best = merged.drop("new")
        frontier = merged.where("new").drop("new")
        if frontier.isEmpty():
            return best


def closeness_centrality(dist: DataFrame) -> DataFrame:
    """reachable / sum of distances, 0 for a node that reaches none."""
    return dist.groupBy(F.col("source").alias("node")).agg(
        (F.count(F.lit(1)) - 1).alias("reachable"), F.sum("distance").alias("__t")
    ).select("node", F.when(F.col("__t") > 0, F.col("reachable") / F.col("__t")).otherwise(0.0).alias("closeness"))


def closeness_by_sketch(adj: DataFrame, lg_k: int = 12, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """node, reachable, closeness by steps, from a sketch of the nodes within 1, 2, 3 .. steps of each.

    A round merges the sketches of the neighbours along the edges, so the work is edges times
    rounds, and no row for a pair of nodes is made. What a sketch counts more than in the round
    before lies that many steps away. Counts have a standard error of about ``1.04 / sqrt(2**lg_k)``,
    1.6 % by default; degrees, and sets of up to 384 nodes, are counted exactly. Rounds end when no
    sketch changes, after as many as the longest of the shortest paths has steps.

    Where ``share_bytes`` hold some registers of all nodes, a task takes these through all rounds.
    Otherwise a sketch is sent only after it changed, and once to each part of the nodes that holds
    neighbours; where the messages of a round come to more than ``share_bytes``, the registers are served
    in shares, up to ``SLOTS``, one after the other through all rounds (see ``sketches``).
    """
    nodes = cut_lineage(degrees(adj))
    width = 1 << lg_k
    parts_of = lambda n, m: sketches.parts_of(adj.sparkSession, n, m, width // SLOTS)
    with Blocks(adj, nodes, parts_of=parts_of) as net:
        shares = 1
        while shares < SLOTS and net.count * net.parts * width > shares * share_bytes:
            shares *= 2
        changes = sketches.Changes(net, lg_k, shares, share_bytes)
        sizes = changes.sizes(sketches.counted(net, adj, changes))
        reachable = F.col("seen") - 1
        closeness = F.when(F.col("steps") > 0, reachable / F.col("steps")).otherwise(0.0)
        rows = net.nodes.join(sizes, "id").select("node", reachable.alias("reachable"), closeness.alias("closeness"))
        out = cut_lineage(rows)
        changes.drop()
        return out


def betweenness_centrality(adj: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Path counts by breadth-first levels from each source, then dependencies level by
    level backwards. Both ends of a pair count, as does the factor 2/((n-1)(n-2))."""
    nodes = cut_lineage(nodes_of(adj))
    n = nodes.count()
    start = (nodes if sources is None else sources).select(F.col("node").alias("source"))
    seen = cut_lineage(start.select("source", F.col("source").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
    step = adj.select(F.col("src").alias("node"), "dst")
    level = 0
    while True:
        grown = (
            seen.where(F.col("level") == level)
            .join(step, "node")
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.sum("sigma").alias("sigma"))
            .join(seen.select("source", "node"), ["source", "node"], "left_anti")
            .withColumn("level", F.lit(level + 1))
        )
        merged = cut_lineage(seen.unionByName(grown))
        level += 1
        seen = merged
        if merged.where(F.col("level") == level).isEmpty():
            break
    depth = level - 1
    # dependency of each (source, node), filled from the deepest level up
    delta = seen.where(F.col("level") == depth).select("source", "node", "level", "sigma", F.lit(0.0).alias("delta"))
    done = delta
    for lv in range(depth - 1, -1, -1):
        below = delta.select("source", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        here = seen.where(F.col("level") == lv)
        passed = (
            here.join(step, "node")
            .join(below, ["source", "dst"])
            .groupBy("source", "node")
            .agg(F.sum("share").alias("share"))
        )
        delta = cut_lineage(
            here.join(passed, ["source", "node"], "left").select(
                "source", "node", "level", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")
            )
        )
        done = done.unionByName(delta)
    summed = done.where(F.col("source") != F.col("node")).groupBy("node").agg(F.sum("delta").alias("__b"))
    norm = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(summed, "node", "left").select(
        "node", (F.coalesce("__b", F.lit(0.0)) * norm).alias("betweenness")
    )


def shortest_path(adj: DataFrame, source: str, target: str) -> DataFrame:
    """Cheapest path with its nodes; equal costs fall to the smaller node list."""
    best = adj.sparkSession.range(1).select(
        F.lit(source).alias("node"), F.struct(F.lit(0.0).alias("distance"), F.array(F.lit(source)).alias("path")).alias("way")
    )
    frontier = best
    hop = adj.select(F.col("src").alias("node"), "dst", "weight")
    while True:
        tried = (
            frontier.join(hop, "node")
            .where(~F.array_contains("way.path", F.col("dst")))
            .groupBy(F.col("dst").alias("node"))
            .agg(
                F.min(
                    F.struct(
                        (F.col("way.distance") + F.col("weight")).alias("distance"),
                        F.concat("way.path", F.array("dst")).alias("path"),
                    )
                ).alias("tried")
            )
        )
        merged = cut_lineage(
            best.join(tried, "node", "full").select(
                "node",
                F.least("way", "tried").alias("way"),
                (F.col("tried").isNotNull() & (F.col("way").isNull() | (F.col("tried") < F.col("way")))).alias("new"),
            )
        )
        best = merged.drop("new")
        frontier = merged.where("new").drop("new")
        if frontier.isEmpty():
            return best.where(F.col("node") == target).select("way.distance", "way.path")


def label_propagation(adj: DataFrame, max_iter: int = 100) -> DataFrame:
    """All nodes take the most frequent label around them at once; ties fall to the
    smallest label. Ends on no change or on a two-round swing; raises ``NotConverged``
    after ``max_iter`` rounds."""
    with Placed(adj) as net:
        labels, last = net.nodes.select("node", "slices", F.col("node").alias("label"), F.col("node").alias("before")), None
        for _ in range(max_iter):
            counts = net.along(labels, F.col("label")).groupBy(F.col("dst").alias("node"), "label").agg(
                F.count(F.lit(1)).alias("k")
            )
            chosen = counts.groupBy("node").agg(F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("b"))
            old = labels.withColumnRenamed("label", "__l")
            kept = Kept(
                chosen.join(old, "node").select(
                    "node", "slices", F.col("b.label").alias("label"), F.col("__l").alias("before"), F.col("before").alias("__b")
                ),
                F.count_if(F.col("label") != F.col("before")).alias("changed"),
                F.count_if(F.col("label") != F.col("__b")).alias("swung"),
            )
            if last is not None:
                last.drop()
            labels, last = kept.rows.drop("__b"), kept
            if not kept.told["changed"] or not kept.told["swung"]:
                return labels.select("node", "label")
    raise NotConverged("label propagation", max_iter, labels.select("node", "label"))


def local_moves(adj: DataFrame) -> DataFrame:
    """Nodes move to the neighbouring community they have most more links to than to
    their own, until none gains by it.

    Of the nodes that want to move, those do whose turn (a hash of node and round) comes
    before that of all neighbours that want to. No two neighbours move at once, so each
    move adds the links it counted: links inside communities grow in every round, and
    the rounds end by themselves.
    """
    with Placed(adj) as net:
        state, last, turn = net.nodes.select("node", "slices", F.col("node").alias("community")), None, 0
        while True:
            around = net.along(state, F.col("community").alias("near")).groupBy(F.col("dst").alias("node"), "near").agg(
                F.count(F.lit(1)).alias("k")
            )
            links = around.join(state, "node").groupBy("node", "slices", "community").agg(
                F.coalesce(F.max(F.when(F.col("near") == F.col("community"), F.col("k"))), F.lit(0)).alias("stay"),
                F.min(F.when(F.col("near") != F.col("community"), F.struct((-F.col("k")).alias("k"), "near"))).alias("go"),
            )
            wants = -F.col("go.k") > F.col("stay")
            wish = Kept(
                links.select(
                    "node", "slices", "community",
                    F.when(wants, F.col("go.near")).alias("to"),
                    F.when(wants, F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("turn"),
                ),
                F.count("to").alias("willing"),
            )
            if last is not None:
                last.drop()
            last = wish
            if not wish.told["willing"]:
                return wish.rows.select("node", "community")
            first = net.along(wish.rows.where(F.col("to").isNotNull()), F.col("turn").alias("other")).groupBy(
                F.col("dst").alias("node")
            ).agg(F.min("other").alias("other"))
            goes = F.col("to").isNotNull() & (F.col("other").isNull() | (F.col("turn") < F.col("other")))
            moved = Kept(
                wish.rows.join(first, "node", "left").select(
                    "node", "slices", F.when(goes, F.col("to")).otherwise(F.col("community")).alias("community")
                ),
                F.count(F.lit(1)).alias("n"),
            )
            last.drop()
            state, last, turn = moved.rows, moved, turn + 1


def modularity(adj: DataFrame, communities: DataFrame) -> DataFrame:
    """Sum over ordered pairs of one community of (weight - expected) / 2m, in sums per
    community: no pair is ever formed."""
    d = degrees(adj).join(communities.select("node", "community"), "node")
    m2 = d.agg(F.sum("degree").alias("m2")).scalar()
    c = communities.select(F.col("node").alias("src"), F.col("community").alias("c1"))
    e = communities.select(F.col("node").alias("dst"), F.col("community").alias("c2"))
    inner = adj.join(c, "src").join(e, "dst").where(F.col("c1") == F.col("c2")).agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("win")
    )
    per = d.groupBy("community").agg(F.sum("degree").alias("k"), F.sum(F.col("degree") * F.col("degree")).alias("k2"))
    expected = per.agg(F.sum(F.col("k") * F.col("k") - F.col("k2")).alias("x"))
    return expected.select(((inner.scalar() - F.col("x") / m2) / m2).alias("modularity"))


def connected_components(adj: DataFrame) -> DataFrame:
    """Smallest node of each component: neighbours' labels, then labels of labels, so a
    chain of any length halves in a round. A label is a node's part and place in it."""
    with Blocks(adj, cut_lineage(degrees(adj))) as net:

        def start(part, ids, degrees):
            return {"part": part, "label": ((part << 32) + np.arange(len(ids) // 8, dtype=np.int64)).tobytes(), "moved": 0}

        def lower(part, label, got):
            old = np.frombuffer(label, np.int64)
            low = np.minimum(old, np.frombuffer(got, np.int64))
            return {"part": part, "label": low.tobytes(), "moved": int((low != old).sum())}

        def asked(batches):
            for batch in batches:
                for part, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    asks = np.unique(np.frombuffer(label, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asks), part, np.int32)), pa.array(asks)], ["part", "ask"])

        def jump(part, label, asks, answers):
            low, asks = np.frombuffer(label, np.int64), np.array(asks, np.int64)
            order = np.argsort(asks)
            found = np.array(answers, np.int64)[order][np.searchsorted(asks[order], low)]
            return {"part": part, "label": found.tobytes(), "moved": int((found != low).sum())}

        def places(batches):
            for batch in batches:
                for part, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    labels = np.frombuffer(label, np.int64)
                    at = (part << 32) + np.arange(len(labels), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(labels)], ["ask", "answer"])

        state, moves = "part int, label binary, moved long", F.sum("moved").alias("moved")
        last = net.kept(net.vectors, start, state, moves)
        while True:
            got = net.gathered(last.rows.select("part", F.col("label").alias("given")), np.int64, "min")
            low = net.kept(last.rows.select("part", "label").join(got, "part"), lower, state, moves)
            last.drop()
            last = low
            if not low.told["moved"]:
                break
            labels = low.rows.select("part", "label")
            # a part asks for a label once, however many of its nodes bear it
            answers = labels.mapInArrow(asked, "part int, ask long").join(labels.mapInArrow(places, "ask long, answer long"), "ask")
            told = answers.groupBy("part").agg(F.collect_list(F.struct("ask", "answer")).alias("told"))
            last = net.kept(labels.join(told, "part").select("part", "label", F.col("told.ask").alias("asks"), F.col("told.answer").alias("answers")), jump, state, moves)
            low.drop()
        labelled = net.named(last.rows.select("part", "label"), "label", "long")
    least = labelled.groupBy("label").agg(F.min("node").alias("component"))
    return labelled.join(least, "label").select("node", "component")


def clustering(adj: DataFrame) -> DataFrame:
    """Local clustering per node.

    Edges point from the lower to the higher degree, so no node has more than sqrt(2m)
    out-neighbours, hub or not; an edge closes a triangle with each out-neighbour its two
    ends share.
    """
    d = degrees(adj)
    a = adj.join(d.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src")
    a = a.join(d.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst")
    up = cut_lineage(a.where(F.struct("d1", "src") < F.struct("d2", "dst")).select("src", "dst"))
    outs = up.groupBy("src").agg(F.collect_list("dst").alias("outs"))
    closed = (
        up.join(outs, "src")
        .join(outs.select(F.col("src").alias("dst"), F.col("outs").alias("other")), "dst")
        .select("src", "dst", F.explode(F.array_intersect("outs", "other")).alias("third"))
    )
    corners = closed.select(F.explode(F.array("src", "dst", "third")).alias("node"))
    triangles = corners.groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    return d.join(triangles, "node", "left").select(
        "node",
        "degree",
        F.coalesce("triangles", F.lit(0)).alias("triangles"),
        F.coalesce(
            ratio(F.coalesce("triangles", F.lit(0)), F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0.0)
        ).alias("clustering"),
    )


def graph_metrics(adj: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, density, average degree, clustering, components; with distances
    also diameter and average path."""
    n, m = F.col("nodes"), F.col("edges")
    out = clustering(adj).agg(
        F.count(F.lit(1)).alias("nodes"),
        (F.sum("degree") / 2).cast("bigint").alias("edges"),
        F.avg("clustering").alias("clustering"),
    )
    parts = connected_components(adj).agg(F.countDistinct("component").alias("components"))
    out = out.withColumns(
        {"components": parts.scalar(), "density": ratio(2 * m, n * (n - 1)), "average_degree": 2 * m / n}
    )
    if dist is not None:
        far = dist.where(F.col("source") != F.col("node"))
        out = out.withColumns(
            {
                "diameter": far.agg(F.floor(F.max("distance")).cast("int").alias("d")).scalar(),
                "average_path": far.agg(F.avg("distance").alias("a")).scalar(),
            }
        )
    return out


def k_hop(edges: DataFrame, start: str, depth: int, types: Sequence[str] | None = None, limit: int | None = 20) -> DataFrame:
    """Neighbours up to ``depth`` hops with the hop they are first met on and the
    heaviest edge that leads there; ordered by depth, then weight."""
    both = edges.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    )
    if types is not None:
        both = both.where(F.col("type").isin(list(types)))
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("weight"))
    for hop in range(1, depth + 1):
        met = (
            seen.where(F.col("depth") == hop - 1)
            .join(both.select(F.col("src").alias("node"), "dst", F.col("weight").alias("w")), "node")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.max("w").alias("weight"))
            .join(seen.select("node"), "node", "left_anti")
            .select("node", F.lit(hop).alias("depth"), "weight")
        )
        seen = cut_lineage(seen.unionByName(met))
    out = seen.where(F.col("depth") > 0)
    return out if limit is None else out.orderBy("depth", F.desc("weight"), "node").limit(limit)


def simple_paths(adj: DataFrame, source: str, target: str, max_length: int = 4, max_paths: int | None = 5) -> DataFrame:
    """Simple paths up to ``max_length`` edges, heaviest first.

    Paths are grown from both ends and met in the middle; either half is at most two
    edges long for the default length.
    """
    half = max_length // 2
    fore = _walks(adj, source, max_length - half)
    back = _walks(adj, target, half)
    met = fore.join(back.select(F.col("node"), F.col("path").alias("tail"), F.col("weight").alias("w2")), "node")
    whole = met.select(
        F.concat("path", F.reverse(F.slice("tail", 1, F.size("tail") - 1))).alias("path"), (F.col("weight") + F.col("w2")).alias("weight")
    )
    whole = whole.where((F.size("path") == F.size(F.array_distinct("path"))) & (F.size("path") > 1)).distinct()
    out = whole.select("path", (F.size("path") - 1).alias("length"), "weight").dropDuplicates(["path"])
    return out if max_paths is None else out.orderBy(F.desc("weight"), "path").limit(max_paths)


def _walks(adj: DataFrame, start: str, length: int) -> DataFrame:
    walk = adj.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"), F.lit(0.0).alias("weight"))
    out = walk
    for _ in range(length):
        walk = (
            walk.join(adj.select(F.col("src").alias("node"), "dst", F.col("weight").alias("w")), "node")
            .where(~F.array_contains("path", F.col("dst")))
            .select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        )
        out = out.unionByName(walk)
    return out


# --- tables of nodes and edges ------------------------------------------------------


def edges_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where((F.col("src") == a) & (F.col("dst") == b))


def neighbours(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("node"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus a custom node for every endpoint that is not one."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    new = ends.join(nodes.select("id"), "id", "left_anti").withColumn("type", F.lit("custom"))
    return nodes.unionByName(new, allowMissingColumns=True)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes and every edge at them."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")


def subgraph(edges: DataFrame, ids: DataFrame, with_neighbours: bool = False) -> DataFrame:
    """Edges inside the set of ids, or inside it and its neighbours."""
    keep = ids.select("id")
    if with_neighbours:
        out = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        into = edges.join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        keep = keep.union(out).union(into).distinct()
    inside = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi")
    return inside.join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")


def find_nodes(nodes: DataFrame, name: str | None = None, kind: str | None = None, fuzzy: bool = False) -> DataFrame:
    """By type, by exact name, or by containment either way."""
    out = nodes if kind is None else nodes.where(F.col("type") == kind)
    if name is not None:
        n = F.lower("name")
        fits = n.contains(name.lower()) | F.lit(name.lower()).contains(n) if fuzzy else F.col("name") == name
        out = out.where(fits)
    return out


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows per node and edge type."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("node"))
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "type", "rows")


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and 2E/V; null without nodes."""
    both = nodes.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("v"), F.lit(1).alias("e")))
    sums = both.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))
    return sums.withColumn("average_degree", ratio(2 * F.col("edges"), F.col("nodes")))


def find_edges(edges: DataFrame, kind: str | None = None, least_weight: float | None = None) -> DataFrame:
    """By type and by weight."""
    out = edges if kind is None else edges.where(F.col("type") == kind)
    return out if least_weight is None else out.where(F.col("weight") >= least_weight)


def _merged_properties(rows: DataFrame) -> DataFrame:
    """Per id the property map in which the newest value of each name stands, merged entry by
    entry, so a row with very many copies is never one list."""
    entries = rows.select("id", "seq", F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    return entries.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Property maps merged with the newer value winning, labels united.

    Rows are (id, type, properties map, labels array, seq).
    """
    rows = old.unionByName(new)
    kinds = rows.groupBy("id").agg(F.max_by("type", "seq").alias("type"))
    labels = rows.select("id", F.explode("labels").alias("l")).distinct().groupBy("id").agg(F.sort_array(F.collect_list("l")).alias("labels"))
    return kinds.join(_merged_properties(rows), "id", "left").join(labels, "id", "left")


def upsert_edges(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """Property maps merged with the newer value winning, weight and confidence of the
    newest row; ends and type stay those the edge was made with.

    Rows are (id, src, dst, type, weight, confidence, properties map, seq). Rows of one id
    and seq are told apart by their content, so the result does not hang on their order.
    ``parts`` says into how many partitions the ids are dealt, once for all groupings and the join.
    """
    rows = old.unionByName(new)
    rows = rows if parts is None else rows.repartition(parts, "id")
    made = F.min(F.struct("seq", "src", "dst", "type")).alias("made")
    last = F.max(F.struct("seq", "weight", "confidence")).alias("last")
    heads = rows.groupBy("id").agg(made, last).select("id", "made.src", "made.dst", "made.type", "last.weight", "last.confidence")
    return heads.join(_merged_properties(rows), "id", "left")


def schema_errors(nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """Nodes of unknown type, or without a required property of the declared type.

    ``schema`` holds (type, property, value_type), with null properties for types that
    require none; it is joined by type.
    """
    known = schema.groupBy("type").agg(
        F.collect_list(F.when(F.col("property").isNotNull(), F.struct("property", "value_type"))).alias("required")
    )
    value = lambda r: F.try_element_at(F.col("properties"), r["property"])
    numeric = lambda r: r["value_type"].isin("float", "int", "number")
    bad = F.filter(
        "required", lambda r: value(r).isNull() | (numeric(r) & value(r).try_cast("double").isNull())
    )
    checked = nodes.join(known, "type", "left").withColumn(
        "errors",
        F.when(F.col("required").isNull(), F.array(F.lit("unknown type"))).otherwise(F.transform(bad, lambda r: r["property"])),
    )
    return checked.where(F.size("errors") > 0).select("id", "type", "errors")
