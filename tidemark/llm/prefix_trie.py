"""Prefix trie of conversations from padded turn-id matrices.

A turn is a 16-byte digest of role and text, a conversation the bytes of its turns in order, so
that the order of bytes is the order of sequences. Conversations are dealt by range of (turns,
id) into shards of a counted size: every node is one run of the global order, and identical
conversations may stand in several shards. In a shard, turns become numbers, and matrices of
``TILE`` columns (shorter rows padded with 0; a further matrix holds the rows that go on) are
sorted with ``lexsort``. Changes between neighbouring rows, OR-accumulated over the columns,
mark where the nodes of every depth begin, and ``reduceat`` gives their members. Sums over
subtrees go from the deepest nodes up.

Only nodes that hold the first or the last row of a shard can reach into other shards. They are
told apart, by a digest of their turns: their parts are added up, own values of merged nodes go
back once, to the first shard that has them, and are summed along the two paths of each shard.
So no node is collected; a path is as long as the shard's first or last conversation.

A conversation is one row here, 20 bytes a turn. SHA-256 of a node's ids is one chain by its
definition: the ids of a node in several shards stream through one task in bounded pieces.

Defined results: rows without conversation id are left out; turns stand by number, null first,
those of equal number by the first 32 characters of role and of text, then by digest; repeated
rows are turns each; a null role or text is empty; an empty table has no nodes, also no root;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, written

#: Bytes of a turn's digest.
TURN = 16
#: Columns of a matrix.
TILE = 32
#: Turns of a shard, on average.
SHARD_TURNS = 400_000
NO_IDS = hashlib.sha256(b"").hexdigest()


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words and keys for equal turn numbers, of every row with a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    read = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, 32).alias("a"), F.substring(text, 1, 32).alias("b"), role.alias("role"), text.alias("text"))
    schema = read.select("conv_id", "turn", "a", "b", F.lit(b"").alias("digest"), F.lit(0).alias("words")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(i).cast(pa.large_binary()).to_pylist() for i in (4, 5))
            # the length of the role keeps role and text apart; bytes.split() cuts at blank and tab to carriage return
            held = [hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest()[:TURN] for r, t in zip(roles, texts, strict=True)]
            words = [len(t.split()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(held, pa.binary()), pa.array(words, pa.int32())], schema.names)

    return read.mapInArrow(run, schema)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids (digests of the turns in order), words (counts, 4 bytes each) of every conversation."""
    bounded_batches(conversations.sparkSession)
    ordered = hashed_turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "a", "b", "digest").select("conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, ids, counts = None, [], []

        def told(out: list[tuple]) -> pa.RecordBatch:
            names, held, words = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(held, pa.binary()), pa.array(words, pa.binary())], ["conv_id", "ids", "words"])

        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            digests, words = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype("<i4")
            starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(conv)), strict=True):
                if conv[a] != open_id:
                    if open_id is not None:
                        out.append((open_id, b"".join(ids), b"".join(counts)))
                    open_id, ids, counts = int(conv[a]), [], []
                ids.append(b"".join(digests[a:b]))
                counts.append(words[a:b].tobytes())
            if out:
                yield told(out)
        if open_id is not None:
            yield told([(open_id, b"".join(ids), b"".join(counts))])

    return ordered.mapInArrow(run, "conv_id long, ids binary, words binary")


def rebuilt(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``own`` (conv_id, ids, words), the first h turns of each taken from the head of its family.

    The head of a family is the conversation ``c - c % family``, h is ``crc32(c) % most``. A head
    that is absent gives no turns, a shorter one those it has.
    """
    head = F.col("conv_id") - F.col("conv_id") % family
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.substring("ids", 1, TURN * (most - 1)).alias("head_ids"), F.substring("words", 1, 4 * (most - 1)).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumn("head", head).join(heads, "head", "left").withColumn("h", h)

    def spliced(name: str, size: int):
        first = F.coalesce(F.substring(F.col(f"head_{name}"), F.lit(1), F.col("h") * size), F.lit(b""))
        return F.concat(first, F.substring(F.col(name), F.col("h") * size + 1, F.octet_length(name))).alias(name)

    return joined.select("conv_id", spliced("ids", TURN), spliced("words", 4))


# --- one shard


def turn_numbers(ids: bytes) -> np.ndarray:
    """Numbers from 1 in the order of the digests, for the turns of a shard."""
    high, low = np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Shard:
    """Nodes of the trie over the conversations of a shard, by depth."""

    def __init__(self, conv: np.ndarray, ids: bytes, lengths: np.ndarray, words: np.ndarray) -> None:
        n = len(conv)
        self.conv, self.lengths = conv, lengths
        offsets = np.cumsum(lengths) - lengths
        numbers = turn_numbers(ids)
        order = np.lexsort((conv, lengths > 0))
        ends = int((lengths == 0).sum())
        none = np.zeros(1, np.int64)
        #: For each depth: place of the first row, members, least id, words, rows that end here, and their ids.
        self.levels = [dict(start=none, n=np.array([n]), conv=np.array([conv.min()]), words=none, n_ends=np.array([ends]), ends=[conv[order[:ends]]], last=n - 1)]
        place = np.arange(ends, n)
        live, group, t = order[ends:], np.zeros(n - ends, np.int64), 0
        while len(live):
            width = int(min(TILE, lengths[live].max() - t))
            column = np.arange(t, t + width)
            inside = column < lengths[live][:, None]
            matrix = np.zeros((len(live), width), np.int64)
            matrix[inside] = numbers[(offsets[live][:, None] + column)[inside]]
            goes_on = lengths[live] > t + width
            sort = np.lexsort((goes_on, *matrix.T[::-1], group))
            live, matrix, group, goes_on = live[sort], matrix[sort], group[sort], goes_on[sort]
            order[place] = live
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:, 0] |= group[1:] != group[:-1]
            np.logical_or.accumulate(change, axis=1, out=change)
            for c in range(width):
                has = np.flatnonzero(matrix[:, c])
                rows, starts = live[has], np.flatnonzero(change[has, c])
                over = (lengths[rows] == t + c + 1).astype(np.int64)
                n_ends = np.add.reduceat(over, starts)
                # rows that end at a node are its first ones, in the order of their ids
                ended = [conv[rows[a : a + k]] if k else none[:0] for a, k in zip(starts, n_ends, strict=True)]
                self.levels.append(
                    dict(start=place[has][starts], n=np.diff(np.append(starts, len(rows))), conv=np.minimum.reduceat(conv[rows], starts), words=words[offsets[rows[starts]] + t + c], n_ends=n_ends, ends=ended, last=int(place[has[-1]]))
                )
            group = np.cumsum(change[:, -1])[goes_on]
            live, place, t = live[goes_on], place[goes_on], t + width
        self.first, self.final = order[0], order[-1]
        self.sum_up(n)

    def sum_up(self, n: int) -> None:
        """Parents, children, leaves and saved tokens; nodes on the two border paths count for none of their ancestors."""
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            level["childless"] = level["n_ends"] == level["n"]
            #: 0 on the path of the first row, 1 on that of the last row alone, -1 inside.
            path = np.full(len(level["start"]), -1)
            if level["last"] == n - 1:
                path[-1] = 1
            if level["start"][0] == 0:
                path[0] = 0
            level["both"] = len(path) == 1 and level["start"][0] == 0 and level["last"] == n - 1
            level["path"] = path
            inner = path < 0
            below = level.get("below", {k: np.zeros(len(path), np.int64) for k in ("children", "leaves", "saved")})
            level |= below
            level["leaves"] = below["leaves"] + (level["childless"] & inner)
            level["saved"] = below["saved"] + np.where(inner, (level["n"] - 1) * level["words"], 0)
            if depth:
                above = self.levels[depth - 1]
                parent = level["parent"] = np.searchsorted(above["start"], level["start"], side="right") - 1
                above["below"] = {k: np.zeros(len(above["start"]), np.int64) for k in ("children", "leaves", "saved")}
                for name, value in (("children", inner.astype(np.int64)), ("leaves", level["leaves"]), ("saved", level["saved"])):
                    np.add.at(above["below"][name], parent, value)


def ids_hash(held: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, held.tolist())).encode()).hexdigest()


def path_keys(ids: bytes) -> list[bytes]:
    """A digest of the first 0, 1, .. turns."""
    chain = hashlib.sha256()
    out = [chain.digest()]
    for at in range(0, len(ids), TURN):
        chain.update(ids[at : at + TURN])
        out.append(chain.copy().digest())
    return out


#: Rows of a shard: nodes inside it (key is null) and the parts of nodes on its border paths.
PARTS = (
    "shard int, path int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, parent_path int, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, words long, childless boolean, on_both boolean, ends_sha256 string, ends binary"
)
_TYPES = pa.schema(
    [("shard", pa.int32()), ("path", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_path", pa.int32()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("childless", pa.bool_()), ("on_both", pa.bool_()), ("ends_sha256", pa.string()), ("ends", pa.binary())]
)


def shard_rows(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows ``PARTS`` of a shard, a depth or a run of depths a batch."""
    held, counts = table.column("ids").to_pylist(), table.column("words").to_pylist()
    lengths = np.array([len(x) // TURN for x in held], np.int64)
    shard = Shard(table.column("conv_id").to_numpy(), b"".join(held), lengths, np.frombuffer(b"".join(counts), "<i4").astype(np.int64))
    keys = [path_keys(held[row]) for row in (shard.first, shard.final)]
    out, n = [], 0
    for depth, level in enumerate(shard.levels):
        path, size = level["path"], len(level["path"])
        inner = path < 0
        above = shard.levels[depth - 1] if depth else None
        parent_path = above["path"][level["parent"]] if depth else np.full(1, -1)
        known = inner & (parent_path < 0)
        border = [None if p < 0 else keys[p] for p in path.tolist()]
        hashed = [ids_hash(e) if i and k else None for i, k, e in zip(inner.tolist(), level["n_ends"].tolist(), level["ends"], strict=True)]
        columns = [
            np.full(size, number), pa.array(path, mask=inner), np.full(size, depth), [k and k[depth] for k in border], [k[depth - 1] if k and depth else None for k in border], level["conv"],
            pa.array(above["conv"][level["parent"]] if depth else np.zeros(1, np.int64), mask=~known), pa.array(parent_path, mask=~(inner & (parent_path >= 0))), level["n"],
            level["children"], level["leaves"], level["saved"], level["words"], level["childless"], np.full(size, level["both"]), hashed, [None if i else e.astype("<i8").tobytes() for i, e in zip(inner, level["ends"], strict=True)],
        ]
        out.append(pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c, from_pandas=False)).cast(f.type) for c, f in zip(columns, _TYPES, strict=True)], schema=_TYPES))
        n += size
        if n >= 10_000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out, n = [], 0
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def shard_parts(convs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard_rows(TaskContext.get().partitionId(), pa.Table.from_batches(held))

    return convs.select("conv_id", "ids", "words").repartitionByRange(shards, "ids", "conv_id").mapInArrow(run, PARTS)


# --- nodes that reach over shards


def hashed_ends(border: DataFrame) -> DataFrame:
    """key, ends_sha256 of the border nodes at which conversations end; ids come in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([chain.hexdigest()], pa.string())], ["key", "ends_sha256"])

        for batch in batches:
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield told()
                    now, chain = key, hashlib.sha256()
                else:
                    chain.update(b",")
                chain.update(",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
        if now is not None:
            yield told()

    ordered = border.where(F.octet_length("ends") > 0).repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def border_nodes(border: DataFrame) -> DataFrame:
    """The merged border nodes, with key and the columns of the result."""
    first = F.min(F.struct("shard", "path")).alias("owner")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = border.groupBy("key").agg(*sums, first, F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.bool_and("childless").alias("childless"))
    merged = written(merged, "merged")

    own = merged.select("key", "owner", F.col("childless").cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    mine = F.struct("shard", "path") == F.col("owner")
    placed = border.select("key", "shard", "path", "depth", "on_both").join(own, "key").select("key", "shard", "path", "depth", "on_both", *(F.when(mine, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")))
    down = Window.partitionBy("shard", "path").orderBy(F.desc("depth"))
    beside = Window.partitionBy("shard")

    def below(c: str):
        return (F.sum(c).over(down) + F.when(F.col("on_both"), F.coalesce(F.sum(F.when(F.col("path") == 1, F.col(c))).over(beside), F.lit(0))).otherwise(0)).alias(c)

    summed = placed.select("key", below("leaf"), below("saved")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    children = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    told = merged.join(summed, "key").join(children, "key", "left").join(parents, "parent_key", "left").join(hashed_ends(border), "key", "left")
    return told.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs",
        (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), "ends_sha256",
    )


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``convs`` (conv_id, ids, words; ids are unique).

    conv_id is the smallest member, parent_conv_id that of the parent; n_leaves and saved_tokens
    are sums over the subtree; ends_sha256 is the hash of the ids that end at the node.
    """
    convs = written(convs, "sequences")
    turns, n = convs.agg(F.sum(F.octet_length("ids") / TURN), F.count(F.lit(1))).first()
    shards = max(1, -(-(int(turns or 0) + n) // shard_turns))
    parts = written(shard_parts(convs, shards), "parts")
    inside, border = parts.where("key is null"), parts.where("key is not null")
    nodes = written(border_nodes(border), "nodes")
    # parents on a path are met by shard, so that the children of the root are as spread as the shards
    above = border.join(nodes.select("key", F.col("conv_id").alias("up")), "key").select("shard", F.col("path").alias("parent_path"), (F.col("depth") + 1).alias("depth"), "up")
    hung = inside.where("parent_path is not null").drop("parent_conv_id").join(above, ["shard", "parent_path", "depth"]).withColumnRenamed("up", "parent_conv_id")
    every = inside.where("parent_path is null").select(*RESULT).unionByName(hung.select(*RESULT)).unionByName(nodes.select(*RESULT))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))


def conversation_trie(conversations: DataFrame, family: int = 20, most: int = 4, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) after :func:`rebuilt`."""
    return trie(rebuilt(written(sequences(conversations), "own"), family, most), shard_turns)


def conversation_trie_sql() -> str:
    return r"""
WITH ordered AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 32), left(coalesce(text, ''), 32),
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(said ORDER BY place) AS said FROM ordered GROUP BY conv_id
), chosen AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(p.said[1:c.h], []), c.said[c.h + 1:]) AS said
  FROM chosen c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20
), reached AS (
  SELECT conv_id, len(said) AS turns, d AS depth, said[1:d] AS key FROM built, unnest(range(len(said) + 1)) AS r(d)
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(turns = depth) AS childless,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(key[depth].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM reached GROUP BY key, depth
), spread AS (
  SELECT key[1:d] AS key, d AS depth, childless, (n_convs - 1) * words AS saved FROM nodes, unnest(range(depth + 1)) AS r(d)
), sums AS (
  SELECT key, depth, count(*) FILTER (childless) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY key, depth
), children AS (
  SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key
LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
"""
