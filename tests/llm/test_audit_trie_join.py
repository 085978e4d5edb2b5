"""Filter audit, prefix trie and Jaccard join against plain versions, and on awkward tables."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import filter_audit, jaccard_join, prefix_trie, sketch

WORD = re.compile("[^\x20\x09-\x0d]+")


def upper_words(text):
    return WORD.findall(text or "")


# --- sketch


def test_sketch_clears_only_what_was_met_once(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**62, 6000)
    rows = np.concatenate((keys, keys[:500], keys[:3].repeat(400)))
    df = spark.createDataFrame([(int(k),) for k in rows], "key long").repartition(5)
    held = sketch.Sketch(df, lambda b: jaccard_join.node_words(b.column(0).to_numpy()), len(rows), 2)
    met = held.met(jaccard_join.node_words(keys))
    assert met[:500].all()
    assert met[500:].mean() < 0.05
    assert held.met(jaccard_join.node_words(keys[:0])).shape == (0,)


# --- filter audit


def plain_audit(docs, labels):
    texts = defaultdict(list)
    for r in docs:
        if r.doc_id is not None:
            texts[r.text or ""].append(r.doc_id)
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in (1, 2))
    masks = []
    for r in docs:
        t = r.text or ""
        w = upper_words(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if r.doc_id is not None and min(texts[t]) < r.doc_id:
            fails.add("E")
        masks.append((r.source or "", fails, r.doc_id in good, r.doc_id in toxic))
    out = {}
    parts = {m[0] for m in masks}
    for part in parts:
        mine = [m for m in masks if m[0] == part]
        shapley = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            live = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in live if x in m[1]]
                before = len(live)
                live = [m for m in live if x not in m[1]]
                shapley[x] += len(gone)
                redundant = sum(x in m[1] for m in mine) - len(gone)
                out[part, order, step] = [len(live), before - len(live), redundant, sum(m[1] == {x} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, 1), (3, 1, None), (4, 1, 1), (None, 1, 1), (77, 1, 1), (6, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_is_the_plain_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = audited(filter_audit.audit_filters(docs, labels))
    assert got == plain_audit(docs.collect(), labels.select("doc_id", "quality", "toxic").collect())
    assert len(got) == 600 * docs.select("source").distinct().count()


def test_audit_awkward(spark, awkward, nothing, marks):
    got = audited(filter_audit.audit_filters(awkward, marks))
    assert got == plain_audit(awkward.collect(), marks.collect())
    # the null and the empty text are equal: 3 repeats 2, in the part of the null source
    assert got["", "EABCD", 1][1] == 1
    assert filter_audit.audit_filters(nothing, marks).count() == 0
    assert audited(filter_audit.audit_filters(awkward, marks.limit(0)))["a", "ABCDE", 1][4:6] == [0, 0]


def test_audit_of_a_hot_text(spark, marks):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", f"s{i % 2}") for i in range(3000)] + [(0, "same text", "s0")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = audited(filter_audit.audit_filters(docs, marks))
    assert got["s0", "EABCD", 1][1] == 499 and got["s1", "EABCD", 1][1] == 500
    assert got == plain_audit(docs.collect(), marks.collect())


# --- prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            turns[r.conv_id].append(r)
    own = {}
    for c, said in turns.items():
        key = lambda r: (r.turn is not None, r.turn or 0, (r.role or "")[:32], (r.text or "")[:32], hashlib.sha256(f"{len((r.role or '').encode())}:{r.role or ''}{r.text or ''}".encode()).digest())
        own[c] = [(r.role or "", r.text or "") for r in sorted(said, key=key)]
    members = defaultdict(list)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = set()
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(upper_words(node[-1][1])) if node else 0
        childless = all(built[c] == node for c in convs)
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * words
            leaves[node[:d]] += childless
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in prefix_trie.RESULT) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [prefix_trie.SHARD_TURNS, 40])
def test_trie_is_the_plain_one(spark, folder, shard_turns):
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    assert told(prefix_trie.conversation_trie(rows, shard_turns=shard_turns)) == plain_trie(rows.collect())


def made_conversations(seed):
    """Few turns, many shared prefixes, identical conversations, and some longer than two matrices."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(400, 180, replace=False).tolist():
        long = c % 9 == 0
        n = int(rng.integers(60, 75)) if long else int(rng.integers(1, 6))
        for t in range(n):
            pick = 0 if long and t < 58 else int(rng.integers(0, 3))
            rows.append((c, t, ("user", "assistant")[t % 2], f"words {'and ' * pick}turn {pick}"))
    return rows


@pytest.mark.parametrize(("seed", "shard_turns"), [(0, 10_000), (1, 300), (2, 25)])
def test_trie_over_shards(spark, seed, shard_turns):
    df = spark.createDataFrame(made_conversations(seed), "conv_id long, turn long, role string, text string")
    assert told(prefix_trie.conversation_trie(df, shard_turns=shard_turns)) == plain_trie(df.collect())


def test_trie_of_equal_conversations(spark):
    """A third of all conversations are the same; their ids are hashed over several shards."""
    rows = [(c, t, "user", f"hello {t}" if c % 3 == 0 else f"own {c} {t}") for c in range(1000, 1600) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = prefix_trie.sequences(df)
    got = {(r.depth, r.conv_id): r for r in prefix_trie.trie(own, 60).collect()}
    same = [c for c in range(1000, 1600) if c % 3 == 0]
    node = got[3, same[0]]
    assert node.n_convs == len(same) and node.n_children == 0 and node.n_leaves == 1
    assert node.ends_sha256 == hashlib.sha256(",".join(map(str, same)).encode()).hexdigest()
    root = got[0, 1000]
    assert root.n_convs == 600 and root.n_leaves == 401 and root.n_children == 401 and root.parent_conv_id is None


def test_trie_awkward(spark):
    rows = [
        (20, 0, "user", "one two"), (20, 0, "user", "one two"), (20, None, None, None), (20, 1, "user", ""), (21, 0, "user", "one"), (21, 0, "assistant", "one"), (21, 0, "assistant", "zwei Ünï"),
        (None, 0, "user", "lost"), (None, None, None, None), (-5, 3, "user", "x " * 50_000), (0, 5, "a", "b"), (39, 0, "user", "alone"), (59, 1, "user", "no head"), (59, 2, "user", "none"),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = df.select("*", *(F.lit(1).alias(c) for c in ("ids", "words", "digest", "a", "b", "head", "h", "key", "shard", "path", "depth")))
    assert told(prefix_trie.conversation_trie(clashing)) == plain_trie(df.collect())
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(df.where("conv_id is null")).count() == 0


# --- Jaccard join


def plain_sets(texts, size=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = upper_words((t or "").translate(lower))
        out.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    return out


def plain_components(rows):
    sets = plain_sets([r.text for r in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(sets[i]), least.get(find(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows)), key=str)


def components_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_join_is_the_plain_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert components_of(jaccard_join.jaccard_components(docs)) == plain_components(docs.collect())


def near_texts(seed):
    """Chains at the threshold, common passages, equal sizes, and short texts."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    common = word(60)
    rows, i = [], 0
    for _ in range(30):
        base = word(int(rng.integers(5, 90)))
        if rng.random() < 0.5:
            base = common + base
        for _ in range(int(rng.integers(1, 5))):
            base = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(base)))
                if rng.random() < 0.5:
                    base[at] = f"v{rng.integers(0, 50)}"
                else:
                    base.insert(at, f"v{rng.integers(0, 50)}")
            rows.append((i, " ".join(base).title() if i % 5 == 0 else "\n".join(base)))
            i += 1
    return rows + [(i + k, " ".join(common[:k])) for k in range(12)]


@pytest.mark.parametrize(("seed", "block"), [(0, 512), (1, 3)])
def test_join_of_near_texts(spark, seed, block):
    df = spark.createDataFrame(near_texts(seed), "doc_id long, text string").repartition(3)
    assert components_of(jaccard_join.jaccard_components(df, block=block)) == plain_components(df.collect())


def test_tiles_take_turns(spark, monkeypatch):
    """Sets reach the crowded tiles in turns, each written before the next, with the same components."""
    df, turns = spark.createDataFrame(near_texts(2), "doc_id long, text string").repartition(3), []

    def seen(rows, kind, *rest):
        turns.append(kind)
        return written(rows, kind, *rest)

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", seen)
    monkeypatch.setattr(jaccard_join, "TURN_BYTES", -1)
    assert components_of(jaccard_join.jaccard_components(df)) == plain_components(df.collect())
    assert turns.count("mixed") == jaccard_join.TURNS > 1


def test_tiles_settle_what_heads_do_not(spark):
    """In one tile the least node is like none of the others, which form two components."""
    rng = np.random.default_rng(5)
    shared = rng.integers(2**62, 2**63, 60, dtype=np.uint64)
    make = lambda core, extra: np.unique(np.concatenate((shared[core], rng.integers(2**62, size=extra).astype(np.uint64))))
    sets = [make(slice(0, 20), 40)] + [make(slice(0, 58), 2) for _ in range(4)] + [np.unique(np.concatenate((shared[:15], np.arange(1000, 1044, dtype=np.uint64), [np.uint64(k)]))) for k in range(4)]
    nodes, bitmaps = list(range(1, len(sets) + 1)), [jaccard_join.bitmap(s).tobytes() for s in sets]
    sizes, none = np.array([len(s) for s in sets]), np.zeros(len(sets), int)
    found = jaccard_join.tile_marks(np.array(nodes), none, none, sizes, none, bitmaps, 85)
    links = jaccard_join.tile_links(nodes, nodes, found, sets, 85)
    groups = {frozenset(g) for g in ({2, 3, 4, 5}, {6, 7, 8, 9})}
    assert len(links) == 6 and all(any({u, v} <= g for g in groups) for u, v in links)


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.8, 1)], rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64))))
        if not len(b):
            continue
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        words = min(len(x), len(y))
        may = jaccard_join.may_reach(len(a), jaccard_join.folded(x, words), np.array([len(b)]), jaccard_join.folded(y, words)[None], 85)[0]
        both = len(np.intersect1d(a, b))
        exact = 100 * both >= 85 * (len(a) + len(b) - both)
        assert jaccard_join.linked(a, b, 85) == exact and (may or not exact)
        if exact:
            classes = rng.integers(0, 5, jaccard_join.COUNTERS).astype(np.uint8)
            assert set(jaccard_join.prefix(a, classes, 85).tolist()) & set(jaccard_join.prefix(b, classes, 85).tolist())


def test_join_awkward(spark, awkward, nothing):
    assert components_of(jaccard_join.jaccard_components(awkward)) == plain_components(awkward.collect())
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_shingles_of_a_batch_are_those_of_its_texts():
    texts = ["a b c d e", None, "", "A B", "a  b\tC\nd", "x", "a b c d e", "!! a, b. c"]
    sets = jaccard_join.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(s) for s in plain_sets(texts)]
    assert sets[0].tolist() == sets[6].tolist() and set(sets[4].tolist()) < set(sets[0].tolist())
    assert [s.tolist() for s in sets] == [jaccard_join.shingle_sets(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert (jaccard_join.node_ids(sets) == 0).tolist() == [s == set() for s in plain_sets(texts)]


def test_texts_are_hashed_in_small_pieces():
    """Pieces hold all rows in order, at most the bytes asked for, and a longer text alone."""
    import pyarrow as pa

    from tidemark.llm.shared import small_pieces

    texts = ["ab" * 10, None, "", "x" * 100, "é" * 5, "y" * 30, "z" * 30, None]
    batch = pa.record_batch([pa.array([9, *range(8)]), pa.array(["cut", *texts])], names=["id", "text"]).slice(1)
    pieces = list(small_pieces([batch, batch.slice(0, 0), batch], 1, 40))
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts * 2
    sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in pieces]
    assert all(sum(s) <= 40 or len(s) == 1 for s in sizes) and len(pieces) < 2 * len(texts)
