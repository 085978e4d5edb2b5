"""Small cases worked out by pandas, numpy, brute force or by hand."""

import datetime as dt
import itertools
import re
import time
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.columns import compounded, ewm_means, ordered, rolling_by_lags
from tidemark.functions import lexicons as lx
from tidemark.functions import symbols as sy
from tidemark.operators import entities as en
from tidemark.operators import evaluation as ev
from tidemark.operators import feature_store as fs
from tidemark.operators import graph as g
from tidemark.operators import knowledge as kn
from tidemark.operators import factors as fc
from tidemark.operators import metrics as mt
from tidemark.operators import portfolio as pf
from tidemark.operators import predicates as pr
from tidemark.operators import quality_bars as qb
from tidemark.operators import relations as rl
from tidemark.operators import sentiment as se
from tidemark.operators import weights as wt
from tidemark.operators.blocks import Blocks
from tidemark.operators.features import FeatureBook, grouped_feature
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.stream_queries import setting
from tidemark.sources import graph_store as gs
from tidemark.sources import store
from tidemark.streaming import stateful as sf
from tidemark.streaming import streams as st

DAY0 = dt.date(2024, 1, 1)


def bars(spark, closes, symbol="A"):
    rows = [
        (symbol, DAY0 + dt.timedelta(days=i), c, None if c is None else c + 1, None if c is None else c - 1, c, 100 + i)
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def same(got, want, tol=1e-9):
    want = [None if pd.isna(x) else float(x) for x in want]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == (b is None), (got, want)
        assert a is None or a == pytest.approx(b, abs=tol, rel=tol)


def test_rolling_follows_pandas(spark):
    rng = np.random.default_rng(1)
    closes = [float(x) for x in rng.uniform(10, 20, 60)]
    df = FeatureBook().compute(bars(spark, closes), ["sma", "momentum", "returns", "volume_std"])
    s = pd.Series(closes)
    same(column(df, "sma"), s.rolling(20).mean())
    same(column(df, "momentum"), s / s.shift(10) - 1)
    same(column(df, "returns"), s.pct_change())
    same(column(df, "volume_std"), pd.Series(range(60)).rolling(20).std())


def test_exponential_mean_follows_pandas_with_gaps(spark):
    rng = np.random.default_rng(2)
    s = pd.Series(rng.uniform(10, 20, 700))
    s[[0, 5, 6, 300]] = np.nan
    df = bars(spark, [None if pd.isna(x) else float(x) for x in s])
    out = ewm_means(df, ordered(["symbol"], ["date"]), {"e": ("close", 20), "f": ("close", 26)})
    same(column(out, "e"), s.ewm(span=20).mean(), 1e-10)
    same(column(out, "f"), s.ewm(span=26).mean(), 1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 60])
def test_folds_by_lags(spark, n):
    s = pd.Series(np.random.default_rng(3).normal(size=150))
    df = bars(spark, [float(x) for x in s])
    out = rolling_by_lags(
        df, ordered(["symbol"], ["date"]), n, {"a": (F.col("close"), "sum"), "b": (F.col("close"), "min"), "c": (F.col("close"), "max")}
    )
    roll = s.rolling(n, min_periods=1)
    same(column(out, "a"), roll.sum(), 1e-9)
    same(column(out, "b"), roll.min())
    same(column(out, "c"), roll.max())


def test_rsi_of_flat_and_rising(spark):
    flat = FeatureBook().compute(bars(spark, [5.0] * 20), ["rsi"])
    assert set(column(flat, "rsi")) == {None}
    up = column(FeatureBook().compute(bars(spark, [float(i) for i in range(1, 21)]), ["rsi"]), "rsi")
    assert up[:13] == [None] * 13 and set(up[13:]) == {100.0}


def test_short_series_and_bad_values(spark):
    df = FeatureBook().compute(bars(spark, [1.0, float("nan"), float("inf"), 0.0, 2.0]), ["sma", "returns"])
    assert column(df, "sma") == [None] * 5
    assert column(df, "returns") == [None, 0.0, 0.0, -1.0, None]


def test_missing_input_is_named(spark):
    with pytest.raises(ValueError, match="volume"):
        FeatureBook().compute(bars(spark, [1.0]).drop("volume"), ["vwap"])


def test_pandas_feature(spark):
    df = grouped_feature(bars(spark, [1.0, 2.0, 4.0]), "doubled", lambda f: f["close"] * 2)
    assert column(df, "doubled") == [2.0, 4.0, 8.0]


def test_quantiles_are_exact_under_skew(spark):
    rng = np.random.default_rng(4)
    hot = np.concatenate([np.full(5000, 3.0), rng.normal(size=7000)])
    rows = [("hot", float(x)) for x in hot] + [("one", 7.0)] + [("few", float(x)) for x in (1, 2, 3, 10)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b, r.c) for r in exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}).collect()}
    for k in ("hot", "one", "few"):
        values = [v for n, v in rows if n == k]
        assert got[k] == pytest.approx(tuple(np.percentile(values, [5, 50, 99])))


def test_buckets_give_the_remainder_to_the_last(spark):
    rows = [("f", "A", DAY0 + dt.timedelta(days=i), float(i // 2), float(i)) for i in range(23)]
    panel = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double, fwd_ret double")
    sizes = {r.bucket: r.n for r in ev.bucketed(panel).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 4, 1: 4, 2: 4, 3: 4, 4: 7}


# --- graphs ---------------------------------------------------------------------------


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, dst string, weight double")


def by_node(df, value):
    return {r["node"]: r[value] for r in df.collect()}


def test_path_of_four(spark):
    adj = g.adjacency(edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)]))
    between = by_node(g.betweenness_centrality(adj), "betweenness")
    assert between == pytest.approx({"a": 0, "b": 4 * 2 / 6, "c": 4 * 2 / 6, "d": 0})
    dist = g.distances(adj)
    assert by_node(g.closeness_centrality(dist), "closeness") == pytest.approx({"a": 0.5, "b": 0.75, "c": 0.75, "d": 0.5})
    m = g.graph_metrics(adj, dist).first()
    assert (m.nodes, m.edges, m.components, m.diameter) == (4, 3, 1, 3)
    assert m.clustering == 0 and m.average_path == pytest.approx(10 / 6)


def test_triangle_with_tail_and_second_part(spark):
    adj = g.adjacency(edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("x", "y", 1)]))
    assert by_node(g.clustering(adj), "clustering") == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0, "x": 0, "y": 0})
    parts = by_node(g.connected_components(adj), "component")
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    ranks = by_node(g.pagerank(adj), "rank")
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-5) and max(ranks, key=ranks.get) == "c"


def test_long_chain_components(spark):
    names = [f"n{i:03d}" for i in range(60)]
    adj = g.adjacency(edges(spark, [(a, b, 1) for a, b in zip(names, names[1:])]))
    assert set(by_node(g.connected_components(adj), "component").values()) == {"n000"}


def test_weighted_tie_takes_the_smaller_path(spark):
    adj = g.adjacency(edges(spark, [("a", "b", 1), ("b", "d", 1), ("a", "c", 1), ("c", "d", 1), ("a", "d", 5)]))
    row = g.shortest_path(adj, "a", "d").first()
    assert (row.distance, row.path) == (2.0, ["a", "b", "d"])
    paths = [r.path for r in g.simple_paths(adj, "a", "d").collect()]
    assert paths == [["a", "d"], ["a", "b", "d"], ["a", "c", "d"]]


def test_local_moves_split_two_cliques(spark):
    def clique(names):
        return [(a, b, 1) for a, b in itertools.combinations(names, 2)]

    adj = g.adjacency(edges(spark, clique("abcd") + clique("wxyz") + [("d", "w", 1)]))
    groups = by_node(g.local_moves(adj), "community")
    assert len(set(groups.values())) <= 3
    score = g.modularity(adj, spark.createDataFrame(list(groups.items()), "node string, community string")).first()[0]
    assert score > 0.2


def test_local_moves_end_where_no_node_gains(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a != b}
    adj = g.adjacency(edges(spark, [(f"n{a:02d}", f"n{b:02d}", 1) for a, b in pairs]))
    group = by_node(g.local_moves(adj), "community")
    around = {}
    for r in adj.collect():
        around.setdefault(r.src, []).append(group[r.dst])
    assert set(around) == set(group)
    for node, near in around.items():
        assert max(near.count(c) for c in near) <= near.count(group[node]) or max(near, key=near.count) == group[node]


def test_rounds_leave_the_edges_where_they_lie(spark):
    """A hub in many slices: right sums, and no shuffle or sort of the edges in a round."""
    pairs = [("hub", f"n{i:03d}", 1) for i in range(200)] + [("n000", "n001", 1)]
    adj = g.adjacency(edges(spark, pairs))
    with g.Placed(adj, slice_edges=16) as net:
        slices = net.edges.where("src = 'hub'").groupBy("slice").count().collect()
        assert len(slices) == 13 and max(r["count"] for r in slices) < 40
        state = net.nodes.withColumn("x", F.lit(1.0))
        got = by_node(net.gathered(state, F.col("x"), F.sum), "got")
        want = {n: float(d) for n, d in by_node(g.degrees(adj), "degree").items()}
        assert got == want
        sent = net.along(state, F.col("x"))
        sent.collect()
        plan = sent._jdf.queryExecution().executedPlan().toString()
        edge_side = plan[plan.index("ShuffledHashJoin") :].split("Exchange")[0]
        assert "Bucketed: true" in edge_side and "Sort" not in plan
        assert plan.split("Initial Plan")[0].count("Exchange") == 1, plan


def test_blocks_tell_a_value_once_to_a_part(spark):
    """A hub and a chain in many parts: right sums, no edge moves, and few rows do."""
    pairs = [("hub", f"n{i:03d}", 1) for i in range(200)] + [("n000", "n001", 1)]
    adj = g.adjacency(edges(spark, pairs))
    degree = g.degrees(adj)
    with Blocks(adj, degree, part_edges=60) as net:
        assert net.parts == 7 and net.vectors.count() == 7
        ones = net.kept(net.vectors, lambda part, ids, degrees: {"part": part, "given": np.ones(len(ids) // 8).tobytes()}, "part int, given binary", F.count("part").alias("n"))
        got = net.gathered(ones.rows, np.float64, "sum")
        assert by_node(net.named(got, "got", "double"), "got") == by_node(degree, "degree")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2 and "Sort" not in plan
        assert plan.count("Exchange") == 2, plan
        # the hub is told once to a part, not once to each of its 200 neighbours
        routes = net._routes.rows.selectExpr("sum(length(places)) / 4").first()[0]
        assert routes < 200 + 7 + 7 * 2
    ones.drop()


def test_rounds_in_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2)) if a < b} | {(0, i) for i in range(30, 60)} | {(100 + i, 101 + i) for i in range(40)}
    names = lambda x: f"n{x:03d}"
    adj = g.adjacency(edges(spark, [(names(a), names(b), 1) for a, b in pairs]))
    monkeypatch.setattr(g, "Blocks", partial(Blocks, part_edges=25))
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    ranks, moved = {n: 1 / len(near) for n in near}, 1
    while moved >= 0.02:
        old, ranks = ranks, {n: 0.15 / len(near) + 0.85 * sum(ranks[m] / len(near[m]) for m in near[n]) for n in near}
        moved = sum(abs(ranks[n] - old[n]) for n in near)
    assert by_node(g.pagerank(adj, tolerance=0.02), "rank") == pytest.approx({names(n): r for n, r in old.items()})
    least = {n: n for n in near}
    for _ in near:
        least = {n: min([least[n], *(least[m] for m in near[n])]) for n in near}
    assert by_node(g.connected_components(adj), "component") == {names(n): names(c) for n, c in least.items()}


def test_single_pairs_are_not_merged(spark):
    rows = edges(spark, [("a", "b", 2), ("d", "c", 3), ("e", "e", 1)])
    same = lambda adj: sorted(map(tuple, adj.collect()))
    assert same(g.adjacency(rows, single=True)) == same(g.adjacency(rows)) == [("a", "b", 2.0), ("b", "a", 2.0), ("c", "d", 3.0), ("d", "c", 3.0)]


def test_closeness_by_sketch(spark):
    """Two parts, a path and a random graph of 3000 nodes, against breadth-first search."""
    rng = np.random.default_rng(3)
    n = 3000
    ends = [(f"r{i}", f"r{rng.integers(i)}") for i in range(1, n)] + [tuple(f"r{x}" for x in rng.integers(n, size=2)) for _ in range(n)]
    ends += [(f"p{i}", f"p{i + 1}") for i in range(5)]
    ends = sorted({(min(e), max(e)) for e in ends if e[0] != e[1]})
    edges = spark.createDataFrame([(*e, 1.0) for e in ends], "src string, dst string, weight double")
    got = {r.node: r for r in g.closeness_by_sketch(g.adjacency(edges)).collect()}
    near = {}
    for a, b in ends:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    assert set(got) == set(near)
    for node in [f"p{i}" for i in range(6)] + [f"r{i}" for i in range(0, n, 30)]:
        level, seen, total, steps = [node], {node}, 0, 0
        while level:
            total, steps = total + steps * len(level), steps + 1
            level = list({y for x in level for y in near[x]} - seen)
            seen.update(level)
        want = (len(seen) - 1) / total
        exact = node.startswith("p")
        assert got[node].reachable == pytest.approx(len(seen) - 1, rel=1e-9 if exact else 0.06)
        assert got[node].closeness == pytest.approx(want, rel=1e-9 if exact else 0.06)


def test_rounds_tell_when_they_do_not_settle(spark):
    adj = g.adjacency(edges(spark, [("a", "b", 1), ("b", "c", 1), ("b", "d", 1)]))
    with pytest.raises(g.NotConverged) as told:
        g.pagerank(adj, max_iter=3)
    ranks = {n: 0.25 for n in "abcd"}
    near = {"a": "b", "b": "acd", "c": "b", "d": "b"}
    for _ in range(3):
        ranks = {n: 0.15 / 4 + 0.85 * sum(ranks[m] / len(near[m]) for m in near[n]) for n in ranks}
    assert by_node(told.value.rows, "rank") == pytest.approx(ranks)
    with pytest.raises(g.NotConverged):
        g.eigenvector_centrality(adj, max_iter=20)
    assert by_node(g.label_propagation(adj), "label").keys() == ranks.keys()


def test_rounds_on_no_edges(spark):
    adj = g.adjacency(edges(spark, []))
    for run in (g.pagerank, g.eigenvector_centrality, g.label_propagation, g.local_moves, g.connected_components):
        assert run(adj).count() == 0


def test_modularity_by_pairs(spark):
    pairs = [("a", "b", 2), ("b", "c", 1), ("c", "d", 3), ("a", "d", 1)]
    adj = g.adjacency(edges(spark, pairs))
    group = {"a": 1, "b": 1, "c": 2, "d": 2}
    w = {(a, b): x for a, b, x in pairs} | {(b, a): x for a, b, x in pairs}
    deg = {n: sum(1 for p in w if p[0] == n) for n in group}
    m = len(pairs)
    want = sum(w.get((i, j), 0) - deg[i] * deg[j] / (2 * m) for i in group for j in group if i != j and group[i] == group[j]) / (2 * m)
    got = g.modularity(adj, spark.createDataFrame([(k, str(v)) for k, v in group.items()], "node string, community string")).first()[0]
    assert got == pytest.approx(want)


# --- text -----------------------------------------------------------------------------

TEXT = "贵州茅台董事长今天宣布，公司2024年1月5日净利率上升12.5%。招商银行与贵州茅台合作，投资5G芯片。贵州茅台位于北京，PE 35。600519.SH"
PATTERNS = {"date": lx.ENTITY_PATTERNS["date"], "percentage": lx.ENTITY_PATTERNS["percentage"], "stock": lx.ENTITY_PATTERNS["stock"]}


def brute_mentions(text, patterns, words):
    out, order = [], 0
    for kind, regexes in patterns.items():
        for regex in regexes:
            out += [(m.start(), m.end(), order, m.group(), kind, 0.8) for m in re.finditer(regex, text)]
            order += 1
    order = 1000
    for kind, group in words.items():
        for w in group:
            out += [(i, i + len(w), order, w, kind, 0.9) for i in range(len(text)) if text.startswith(w, i)]
        order += 1
    return sorted(out)


def brute_merge(mentions):
    done, now = [], None
    for m in mentions:
        if now is None:
            now = m
        elif m[0] < now[1] and m[1] > now[0]:
            if m[5] > now[5] or (m[5] == now[5] and len(m[3]) > len(now[3])):
                now = m
        else:
            done.append(now)
            now = m
    return done + ([now] if now else [])


def brute_clean(text):
    text = re.sub(r"\s+", " ", text)
    return re.sub(r"[^一-龥a-zA-Z0-9%$/\s.,;:!?()\[\]{}\"'-]", "", text).strip()


@pytest.mark.parametrize("text", [TEXT, "", "ABABAB 12% 13%", "董事董事长董事"])
def test_entities_by_brute_force(spark, text):
    out = en.extract(spark.createDataFrame([(1, text)], "id int, text string"), "text", PATTERNS, lx.ENTITY_WORDS).first()
    assert out.cleaned == brute_clean(text)
    want = [(m[3], m[4], m[0], m[1]) for m in brute_merge(brute_mentions(out.cleaned, PATTERNS, lx.ENTITY_WORDS))]
    assert [(m.text, m.type, m.start, m.end) for m in out.entities] == want


def test_tails_of_a_stream(spark, tmp_path):
    """Three arrivals, one of them late and one with a repeated row and nulls: new rows come with the two held before them."""
    days = [dt.date(2024, 1, d) for d in range(1, 10)]
    arrivals = [
        [("a", days[0], 1.0), ("a", days[1], 2.0), ("a", days[3], 4.0), ("b", days[0], None)],
        [("a", days[2], 3.0), ("a", days[2], 3.0)],
        [("a", days[5], 6.0), (None, days[0], 7.0)],
    ]
    schema, seen, root = "symbol string, date date, close double", [], str(tmp_path)
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", sf.ROCKS):
        spark.createDataFrame([], schema).write.parquet(f"{root}/in")
        stream = sf.with_tail(st.read_files(spark, f"{root}/in", schema), "symbol", 2)
        for rows in arrivals:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            got = []
            running = stream.writeStream.foreachBatch(lambda batch, number, got=got: got.extend(map(tuple, batch.collect())))
            running.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            seen.append(got)
    assert sorted(seen[0], key=str) == sorted([(*r, True) for r in arrivals[0]], key=str)
    held = [("a", days[1], 2.0, False), ("a", days[3], 4.0, False)]
    assert sorted(seen[1]) == sorted([*held, ("a", days[2], 3.0, True), ("a", days[2], 3.0, True)])
    last = [("a", days[2], 3.0, False), ("a", days[3], 4.0, False), ("a", days[5], 6.0, True), (None, days[0], 7.0, True)]
    assert sorted(seen[2], key=str) == sorted(last, key=str)


def brute_relations(text, found):
    """All ordered pairs of mentions, each pattern and keyword on the context between."""
    best = {}

    def put(s, t, kind, conf):
        key = (s[3], t[3], kind)
        best[key] = max(best.get(key, 0), conf)

    for i, a in enumerate(found):
        for j, b in enumerate(found):
            if i == j:
                continue
            context = text[min(a[0], b[0]) : max(a[1], b[1])]
            for kind, pattern, conf, both, sources, targets in lx.RELATION_PATTERNS:
                if (sources and a[4] not in sources) or (targets and b[4] not in targets):
                    continue
                if re.search(pattern, context, re.I):
                    put(a, b, kind, conf)
                    if both:
                        put(b, a, kind, conf * 0.9)
            for kind, words in lx.RELATION_KEYWORDS.items():
                if any(w in context for w in words):
                    put(a, b, kind, 0.6)
            near = lx.NEAR_RELATIONS.get((a[4], b[4]))
            if near and abs(a[0] - b[0]) <= 100:
                put(a, b, near, 0.4)
    return best


@pytest.mark.parametrize("text", [TEXT, TEXT + "招商银行控制中国平安，北京属于京津冀。" * 2, "贵州茅台 投资 北京"])
def test_relations_by_brute_force(spark, text):
    docs = en.extract(spark.createDataFrame([(1, text)], "id int, text string"), "text", PATTERNS, lx.ENTITY_WORDS)
    row = docs.first()
    found = brute_merge(brute_mentions(row.cleaned, PATTERNS, lx.ENTITY_WORDS))
    rows = rl.extract_relations(docs, "id").collect()
    got = {(r.source, r.target, r.type): r.confidence for r in rows}
    assert got == pytest.approx(brute_relations(row.cleaned, found))
    words = {w for group in lx.RELATION_KEYWORDS.values() for w in group} | {"distance"}
    for r in rows:
        for told in set(r.evidence) - words:
            assert told in pattern_contexts(row.cleaned, found, r.source, r.target, r.type), (r, told)


def pattern_contexts(text, found, source, target, kind):
    """All texts between a mention of the source and one of the target in which a pattern of the kind stands."""
    out = set()
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            if i != j and {a[3], b[3]} == {source, target}:
                context = text[min(a[0], b[0]) : max(a[1], b[1])]
                if any(k == kind and re.search(p, context, re.I) for k, p, *_ in lx.RELATION_PATTERNS):
                    out.add(context)
    return out


def test_relations_of_many_entities(spark):
    names = [f"甲{i:04d}号" for i in range(5000)]
    text = "，".join(names) + "控制" + "北京。"
    words = {"company": names, "city": ["北京"]}
    docs = en.extract(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "甲0001号，" * 3)], "id int, text string"), "text", {}, words)
    rows = rl.extract_relations(docs, "id", lx.RELATION_PATTERNS, lx.RELATION_KEYWORDS, {}).where("type = 'controls'").collect()
    assert {r.source for r in rows if r.target == "北京"} == set(names)
    assert {r.target for r in rows if r.source == "北京"} == set(names)
    assert len(rows) == 2 * len(names) and {r.id for r in rows} == {1}
    last = next(r for r in rows if r.source == names[-1])
    assert last.evidence == sorted({"控制", names[-1] + "控制北京"}) and last.confidence == 0.9


def test_pattern_evidence_is_the_shortest_text(spark):
    text = "招商银行，招商银行控制中国平安，又见中国平安。"
    docs = en.extract(spark.createDataFrame([(1, text)], "id int, text string"), "text", {}, {"company": ["招商银行", "中国平安"]})
    cleaned = docs.first().cleaned
    told = rl.extract_relations(docs, "id", lx.RELATION_PATTERNS, {}, {}).where("type = 'controls'").collect()
    both = [r for r in told if r.source != r.target]
    assert both and all(r.evidence == ["招商银行控制中国平安"] for r in both), both
    own = [r for r in told if r.source == r.target]
    assert all(e in cleaned and e.count(r.source) == 2 for r in own for e in r.evidence)


def test_sentiment_modifiers(spark):
    words = se.Lexicon(["good"], ["bad"], ["flat"], {"soar": 3.0}, {"very": 2.0}, ["not"], [(r"up (\d+)%", 1.0)])
    docs = spark.createDataFrame(
        [(1, "very good"), (2, "not very good"), (3, "flat"), (4, "up 12% bad"), (5, "not good soar")], "id int, text string"
    )
    got = {r.id: r.score for r in se.lexicon_sentiment(docs, "id", "text", words).collect()}
    assert got == pytest.approx({1: 1.0, 2: -1.0, 3: 0.0, 4: 0.5, 5: -1.0})


def test_sentiment_anywhere_reads_unbroken_text(spark):
    docs = spark.createDataFrame([(1, "股价大涨创新高"), (2, "股价没上涨"), (3, "今日开会")], "id int, text string")
    run = {r.id: r.score for r in se.lexicon_sentiment(docs, "id").collect()}
    anywhere = {r.id: r.score for r in se.lexicon_sentiment(docs, "id", anywhere=True).collect()}
    assert run == {1: 0.0, 2: 0.0, 3: 0.0}
    assert anywhere[1] > 0 and anywhere[2] < 0 and anywhere[3] == 0


# --- learners -------------------------------------------------------------------------


def learner_input(spark, days=30, k=4):
    rng = np.random.default_rng(9)
    data = rng.normal(0, 0.02, size=(days, k))
    rows = [("p", f"f{j}", DAY0 + dt.timedelta(days=i), float(data[i, j])) for i in range(days) for j in range(k)]
    return data, spark.createDataFrame(rows, "portfolio_id string, factor_id string, date date, ret double")


def weights_of(df):
    return df.toPandas().pivot(index="date", columns="factor_id", values="weight").to_numpy()


def test_recursive_learners(spark):
    data, df = learner_input(spark)
    k = data.shape[1]
    w = np.full(k, 1 / k)
    P, theta = 1000 * np.eye(k), np.zeros(k)
    want = []
    for x in data:
        y = float(w @ x)
        gain = P @ x / (0.99 + x @ P @ x)
        theta = theta + gain * (y - x @ theta)
        P = (P - np.outer(gain, x @ P)) / 0.99
        w = np.abs(theta) / np.abs(theta).sum()
        want.append(w)
    assert weights_of(wt.learn(df, wt.rls_step())) == pytest.approx(np.array(want), abs=1e-9)

    w, v, want = np.full(k, 1 / k), np.zeros(k), []
    for x in data:
        v = 0.9 * v + 0.01 * x
        w = (w + v) / np.abs(w + v).sum()
        want.append(w)
    assert weights_of(wt.learn(df, wt.momentum_step())) == pytest.approx(np.array(want))

    w, total, want = np.full(k, 1 / k), np.zeros(k), []
    for t, x in enumerate(data, 1):
        total = total + x * w
        u = total / t + 2.0 * np.sqrt(np.log(t) / t)
        w = np.exp(u - u.max()) / np.exp(u - u.max()).sum()
        want.append(w)
    assert weights_of(wt.learn(df, wt.ucb_feedback_step())) == pytest.approx(np.array(want))


def test_random_weights_sum_to_one_and_repeat(spark):
    _, df = learner_input(spark)
    for make in (lambda: wt.thompson_draw_weights(df, seed=3), lambda: wt.learn(df, wt.bandit_step(0.5, seed=3))):
        first, again = weights_of(make()), weights_of(make())
        assert first == pytest.approx(again)
        assert first.sum(axis=1) == pytest.approx(np.ones(len(first)))


# --- tables ---------------------------------------------------------------------------


def test_upsert_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "daily")
    df = bars(spark, [1.0, 2.0, 3.0], "600001.SH").withColumn("amount", F.lit(1.0))
    for _ in range(2):
        store.write_daily_bars(spark, df, root)
    store.write_daily_bars(spark, df.where(F.col("close") == 3.0).withColumn("close", F.lit(9.0)), root)
    assert column(store.read_daily_bars(spark, root), "close") == [1.0, 2.0, 9.0]
    assert store.read_daily_bars(spark, str(tmp_path / "none")).count() == 0
    assert store.files_without_columns(spark, root, ["close", "absent"]).first().lacking == ["absent"]


def test_feature_store_delete_and_keys(spark, tmp_path):
    fstore = fs.FeatureStore(spark, str(tmp_path / "fs"), buckets=2)
    fstore.register(fs.FeatureGroup("g", ("k",)))
    rows = spark.createDataFrame([(i, i * 1.0) for i in range(10)], "k int, v double")
    fstore.put("g", rows, "2024-01-01 00:00:00")
    fstore.delete("g", rows.where("k < 9"))
    assert [r.k for r in fstore.get("g", rows).collect()] == [9]
    assert fstore.names() == ["g"]


def test_gap_fill(spark):
    df = bars(spark, [None, 1.0, None, 3.0, None])
    assert column(qb.fill_gaps(df, "close", "interpolate"), "close") == [None, 1.0, 2.0, 3.0, 3.0]
    assert column(qb.fill_gaps(df, "close", "backward"), "close") == [1.0, 1.0, 3.0, 3.0, None]
    assert column(qb.fill_gaps(df, "close", "drop"), "close") == [1.0, 3.0]


def test_bad_bars_are_found(spark):
    rows = [
        ("A", DAY0, 10.0, 11.0, 9.0, 10.0, 5, 1),
        ("A", DAY0, 10.0, 11.0, 9.0, 10.0, 5, 2),
        ("A", DAY0 + dt.timedelta(days=1), -1.0, 11.0, 9.0, 0.0, -3, 3),
        ("A", dt.date(2030, 1, 1), 10.0, 9.0, 8.0, 30.0, 0, 4),
    ]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long, seq int")
    m = qb.bar_metrics(df, "2024-06-01").first()
    assert (m.duplicate_dates, m.future_dates, m.negative_prices, m.zero_prices, m.negative_volume) == (1, 1, 1, 1, 1)
    assert m.ohlc_errors == 2 and m.extreme_returns == 1 and m.zero_volume_ratio == 0.25


def test_symbols(spark):
    codes = ["600519", " 1.sz", "300750", "999999", "688001.SH", "1234567"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r[0] for r in df.select(sy.standard_symbol(F.col("c"))).collect()]
    assert got == ["600519.SH", "000001.SZ", "300750.SZ", "999999.SZ", "688001.SH", "1234567.SZ"]
    back = df.select(sy.from_prefixed(sy.to_prefixed(sy.standard_symbol(F.col("c"))))).collect()
    assert [r[0] for r in back] == got


def test_cool_down(spark):
    rows = spark.createDataFrame([("r", t, 1) for t in (0, 60, 299, 300, 500, 601)], "rule_id string, tick long, samples long")
    assert sorted(r.tick for r in mt.cool_down(rows, 300).collect()) == [0, 300, 601]


def test_inference_reaches_the_fixpoint(spark):
    t = spark.createDataFrame([(f"n{i}", "p", f"n{i + 1}", 0.9) for i in range(6)], "subject string, predicate string, object string, confidence double")
    out = kn.infer(t, [kn.transitive("p")])
    assert out.count() == 21
    assert kn.exact(t).count() == 0 and kn.by_words(t, "").count() == 0


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(f"S{i % 20}",) for i in range(200)], "symbol string")
    one, two = pr.sample_symbols(df, 5, 1).collect(), pr.sample_symbols(df.repartition(7), 5, 1).collect()
    assert one == two and len(one) == 5


def test_inference_tells_when_rounds_are_not_enough(spark):
    t = spark.createDataFrame([(f"n{i}", "p", f"n{i + 1}", 0.9) for i in range(12)], "subject string, predicate string, object string, confidence double")
    assert kn.infer(t, [kn.transitive("p")]).count() == 78
    with pytest.raises(RuntimeError):
        kn.infer(t, [kn.transitive("p")], max_rounds=1)


# --- total losses and long memories -----------------------------------------------------


def test_growth_is_a_product(spark):
    for rates in ([0.1, -1.0, 0.2], [0.5, -1.5, 0.2, -3.0, 0.1], [-1.0], [0.2, None, -0.1]):
        df = spark.createDataFrame([("p", DAY0 + dt.timedelta(days=i), r) for i, r in enumerate(rates)], "portfolio_id string, date date, ret double")
        want = np.cumprod([1 + (r or 0) for r in rates])
        same(column(pf.growth(df, ["portfolio_id"], "date"), "growth"), want)
        assert df.agg(compounded(F.col("ret")).alias("g")).first().g == pytest.approx(want[-1])
        assert pf.performance(df).first().total_return == pytest.approx(want[-1] - 1)


def test_total_loss_is_the_whole_drawdown(spark):
    df = spark.createDataFrame([("p", DAY0 + dt.timedelta(days=i), r) for i, r in enumerate([0.1, -1.0, 0.2])], "portfolio_id string, date date, ret double")
    one = pf.performance(df).first()
    assert (one.total_return, one.max_drawdown) == (-1.0, -1.0)
    assert column(wt.learning_metrics(df.withColumnRenamed("ret", "portfolio_ret")), "max_drawdown") == [0.0, -1.0, -1.0]


@pytest.mark.parametrize("span", [26, 200, 500])
def test_exponential_mean_has_no_reach(spark, span):
    s = pd.Series(np.random.default_rng(span).uniform(10, 20, 3000))
    out = ewm_means(bars(spark, [float(x) for x in s]), ordered(["symbol"], ["date"]), {"e": ("close", span)})
    same(column(out, "e"), s.ewm(span=span).mean())


def test_any_confidence_level_has_its_quantile(spark):
    df = spark.createDataFrame([("A", float(x)) for x in range(-50, 51)], "symbol string, ret double")
    sd = float(np.std(range(-50, 51)))
    assert pf.value_at_risk(df, 0.975, "parametric").first()["var"] == pytest.approx(-1.959964 * sd, rel=1e-6)


# --- keys that move, copies in a batch, nulls in filters --------------------------------


def test_an_id_of_another_type_replaces_its_row(spark, tmp_path):
    root = str(tmp_path / "nodes")
    row = lambda kind, at: spark.createDataFrame([("a", kind, at), ("b", "stock", at)], "id string, type string, created_at long")
    gs.save(spark, row("company", 1), root)
    gs.save(spark, row("stock", 2), root)
    assert sorted((r.id, r.type) for r in gs.load(spark, root).collect()) == [("a", "stock"), ("b", "stock")]
    assert gs.load(spark, root, "company").count() == 0


def test_copies_in_a_batch_without_sequence_are_settled(spark, tmp_path):
    df = bars(spark, [1.0, 2.0], "600001.SH").withColumn("amount", F.lit(1.0))
    both = df.unionByName(df.withColumn("close", F.col("close") + 5))
    seen = set()
    for i in range(3):
        store.write_daily_bars(spark, both.repartition(i + 1), str(tmp_path / f"s{i}"))
        seen.add(tuple(column(store.read_daily_bars(spark, str(tmp_path / f"s{i}")), "close")))
    assert len(seen) == 1


def test_a_present_null_fails_a_filter(spark):
    rows = spark.createDataFrame([("e", "x", 1), ("e", None, 2)], "event_type string, source string, n int")
    subs = spark.createDataFrame([("s", "e", {"source": ["x"]}), ("t", "e", {"absent": ["y"]})], "subscription_id string, kind string, filters map<string,array<string>>")
    got = sorted((r.subscription_id, r.n) for r in pr.subscribed(rows, subs, ["source"]).collect())
    assert got == [("s", 1), ("t", 1), ("t", 2)]


# --- factor registry --------------------------------------------------------------------


def test_factor_registry_checks_needs_and_status(spark):
    book = fc.FactorRegistry()
    book.register(fc.Factor("a", ("b",), lambda w: F.col("b") + 1))
    book.register(fc.Factor("b", ("close",), lambda w: F.col("close") * 2))
    df = bars(spark, [1.0, 2.0])
    assert column(book.calculate(df, ["a"]), "a") == [3.0, 5.0]
    with pytest.raises(ValueError):
        book.register(fc.Factor("a", ("close",), lambda w: F.col("close")))
    book.set_status("b", "deprecated")
    with pytest.raises(ValueError):
        book.calculate(df, ["a"])
    book.register(fc.Factor("c", ("nothing",), lambda w: F.col("nothing")))
    with pytest.raises(ValueError):
        book.calculate(df, ["c"])
    for x, y in (("d", "e"), ("e", "d")):
        book.register(fc.Factor(x, (y,), lambda w: F.lit(1)))
    with pytest.raises(ValueError):
        book.calculate(df, ["d"])


def test_semantic_search_knows_rare_words(spark):
    rows = [(i, f"common words here {i % 7} filler{i}") for i in range(1200)] + [(5000, "the rarest platypus")]
    got = kn.semantic_search(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "platypus", 5).collect()
    assert [r.doc_id for r in got] == [5000]


def shuffle_mb(spark):
    """MB of shuffle files that the session holds."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).length() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle")) / 1e6


def test_semantic_search_counts_terms_of_repeated_and_null_keys(spark):
    """Rows of one key are one text; null keys too. Lengths follow idf over all of them."""
    rows = [(1, "red fox and blue fox"), (1, "Red FOX"), (2, "red red hen"), (3, None), (4, ""), (None, "blue hen"), (None, "red"), (5, "grey cat")]
    rows += [(10 + i, f"word{i} other{i % 5} red") for i in range(40)]
    got = kn.semantic_search(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text", "red fox red hen", 100).collect()
    bags = {}
    for k, text in rows:
        if text is not None:
            words = text.lower().split()
            bags.setdefault(k, Counter()).update(words + [" ".join(p) for p in zip(words, words[1:], strict=False)])
    n = sum(text is not None for _, text in rows)
    idf = {w: np.log((n + 1) / (sum(w in b for b in bags.values()) + 1)) for b in bags.values() for w in b}
    words = "red fox red hen".split()
    q = {w: c * idf[w] for w, c in Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)]).items() if w in idf}
    size = np.sqrt(sum(x * x for x in q.values()))
    want = {}
    for k, b in bags.items():
        dot = sum(c * idf[w] * q.get(w, 0) for w, c in b.items())
        if dot > 0:
            want[k] = dot / np.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items())) / size
    assert {r.doc_id: r.similarity for r in got} == pytest.approx(want)
    assert [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)


def test_semantic_search_leaves_no_shuffle_of_all_terms(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.xxhash64("id", i).cast("string"))).alias("text"))
    docs = docs.withColumn("text", F.concat_ws(" ", F.lit("asked"), "text"))
    before = shuffle_mb(spark)
    found = kn.semantic_search(docs.unionByName(docs.limit(1).withColumn("text", F.lit("rare asked"))), "doc_id", "text", "rare", 5)
    assert found.count() == 1
    for _ in range(50):
        if (left := shuffle_mb(spark) - before) < 1:
            break
        time.sleep(0.1)
    assert left < 1


def test_written_table_leaves_no_shuffle(spark):
    from tidemark.llm.shared import written

    before = shuffle_mb(spark)
    rows = written(spark.range(300_000).repartition(4, "id"), "rows")
    assert rows.count() == 300_000
    for _ in range(50):
        if (left := shuffle_mb(spark) - before) < 0.2:
            break
        time.sleep(0.1)
    assert left < 0.2


def test_closeness_by_sketch_in_shares(spark, monkeypatch):
    """A round cut into shares gives the rows of a whole one, and no share leaves its messages."""
    ids = spark.range(400)
    edges = ids.select(F.col("id").cast("string").alias("src"), F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(400)).cast("string") for i in range(5)])).alias("dst"), F.lit(1.0).alias("weight"))
    adj = g.adjacency(edges)
    whole = {r.node: r for r in g.closeness_by_sketch(adj).collect()}
    before = shuffle_mb(spark)
    monkeypatch.setattr(g, "SLOTS", 4)
    shares = {r.node: r for r in g.closeness_by_sketch(adj, share_bytes=1).collect()}
    assert len(whole) == 400 and set(shares) == set(whole)
    # an estimate may differ by the order in which sketches are merged
    for node, row in whole.items():
        assert shares[node].reachable == pytest.approx(row.reachable, abs=2)
        assert shares[node].closeness == pytest.approx(row.closeness, rel=0.01)
    for _ in range(50):
        if (left := shuffle_mb(spark) - before) < 1:
            break
        time.sleep(0.1)
    assert left < 1


def student_tail(t, v):
    """Two-sided tail by the finite series for whole degrees of freedom."""
    angle = np.arctan(abs(t) / np.sqrt(v))
    cos2, sin = np.cos(angle) ** 2, np.sin(angle)
    term = total = 1.0 if v > 1 else 0.0
    for j in range(1, (v - 2) // 2 + 1):
        term *= ((2 * j - 1) / (2 * j) if v % 2 == 0 else 2 * j / (2 * j + 1)) * cos2
        total += term
    return 1 - (sin * total if v % 2 == 0 else 2 / np.pi * (angle + sin * np.cos(angle) * total))


def test_student_tail(spark):
    cases = [(t, v) for v in (1, 2, 3, 4, 5, 7, 10, 31, 100, 333, 1000, 4999, 9998) for t in (0.0, 1e-4, 0.03, 0.5, -1.0, 1.96, -3.0, 6.0, 20.0)]
    df = spark.createDataFrame([(float(t), float(v)) for t, v in cases] + [(None, 5.0), (1.0, 0.0), (1.0, -1.0)], "t double, v double")
    got = [r.p for r in df.select(ev.student_p(F.col("t"), F.col("v")).alias("p")).collect()]
    assert got[len(cases) :] == [None, None, None]
    for (t, v), p in zip(cases, got, strict=False):
        assert p == pytest.approx(student_tail(t, v), abs=1e-9)


def test_inference_meets_every_pair_once(spark):
    """A chain closes in a logarithm of its length, and rules see a new fact in every derivation."""
    n = 40
    facts = spark.createDataFrame([(f"k{i:03}", "to", f"k{i + 1:03}", 1.0) for i in range(n)], "subject string, predicate string, object string, confidence double")
    plain = kn.transitive("to", 1.0)
    derived = []

    def counting(new, known):
        out = plain(new, known)
        derived.append(out.count())
        return out

    out = kn.infer(facts, [counting]).collect()
    assert len(out) == n * (n + 1) // 2 == len({(r.subject, r.object) for r in out})
    # a pair of adjoining stretches is a choice of three marks on the chain
    assert sum(derived) == (n + 1) * n * (n - 1) // 6
    assert max(r.round for r in out) == 6
    with pytest.raises(RuntimeError):
        kn.infer(facts, [plain], max_rounds=3)


def test_backfill_closes_all_windows_and_keeps_late_rows(spark, tmp_path):
    """A row that is late inside the hour counts, one beyond is lost, and the last window is told."""
    from tidemark.streaming import stateful, streams

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    files = [[("a", at(10, 0), 1.0), ("a", at(10, 20), 2.0)], [("a", at(12, 0), 3.0)], [("a", at(11, 5), 4.0), ("a", at(9, 0), 5.0)], [("a", at(12, 10), 6.0)]]
    for rows in files:
        spark.createDataFrame(rows, "name string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    source = streams.read_files(spark, f"{tmp_path}/in", schema, per_batch=1)
    out = streams.backfill(lambda rows: stateful.windowed(rows, "15 minutes"), source, f"{tmp_path}/out")
    got = {(r.start.hour, r.start.minute): r["count"] for r in out.collect()}
    assert got == {(10, 0): 1, (10, 15): 1, (11, 0): 1, (12, 0): 2}


def test_uniform_verdict(spark):
    """Distance, p-value and verdict against a plain version; one group holds a third of the rows as one value."""
    from tidemark.operators import quality_features as qf

    rng = np.random.default_rng(4)
    groups = {"even": (np.arange(400) + rng.uniform(0, 1, 400)) / 400, "bent": rng.beta(2, 2, 400), "tied": np.concatenate((np.full(400, 0.5), [0.0, 1.0])), "few": np.array([0.0, 0.3, 1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, v double")
    got = {r.k: r for r in qf.uniform_ks(df, "v", ["k"]).collect()}
    for k, v in groups.items():
        x = np.sort((v - v.min()) / (v.max() - v.min()))
        n = len(x)
        d = max((np.arange(1, n + 1) / n - x).max(), (x - np.arange(n) / n).max())
        reach = np.sqrt(n) * d
        p = min(max(2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * reach * reach) for j in range(1, 101)), 0), 1) if reach >= 0.2 else 1.0
        assert got[k].ks_distance == pytest.approx(d, abs=1e-12) and got[k].p_value == pytest.approx(p, abs=1e-12)
        assert got[k].passed == (p > 0.05)
    assert got["even"].passed and got["few"].passed and not got["bent"].passed and not got["tied"].passed


def test_normality_by_w_and_by_distance(spark):
    """W against a published example, the distance against the plain one, few and constant values."""
    from statistics import NormalDist

    from tidemark.operators import quality_features as qf

    w, p = qf.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert (w, p) == pytest.approx((0.78881, 0.006704), abs=2e-5)
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(3, 2, 400), "bent": rng.exponential(1, 400), "flat": np.full(20, 7.0), "few": np.array([1.0, 2.0, 9.0]),
        "many": rng.normal(0, 1, 6000), "tied": np.round(rng.normal(0, 1, 6000), 1),
    }
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("few", None)], "k string, v double")
    got = {r.k: r for r in qf.distribution_test(df, "v", ["k"]).collect()}
    assert {k: r.method for k, r in got.items()} == {
        "normal": "shapiro", "bent": "shapiro", "flat": "shapiro", "few": "none", "many": "kolmogorov", "tied": "kolmogorov",
    }
    assert {k for k, r in got.items() if r.passed} == {"normal", "flat", "few", "many"}
    for k in ("many", "tied"):
        v = np.sort(groups[k])
        x = np.array([NormalDist(v.mean(), v.std(ddof=1)).cdf(e) for e in v])
        n = len(v)
        d = max((np.arange(1, n + 1) / n - x).max(), (x - np.arange(n) / n).max())
        assert got[k].statistic == pytest.approx(d, abs=2e-7) and got[k].n == n
    even = {r.k: r.method for r in qf.distribution_test(df, "v", ["k"], "uniform").collect()}
    assert set(even.values()) == {"kolmogorov", "none"}
    with pytest.raises(ValueError):
        qf.kolmogorov(df, "v", ["k"], "cauchy")


def test_feature_types_match_by_class(spark):
    from tidemark.operators import quality_features as qf

    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean")
    assert qf.type_matches(df, {"a": "double", "b": "numeric", "c": "categorical", "d": "boolean"}) == dict.fromkeys("abcd", True)
    assert qf.type_matches(df, {"a": "string", "c": "long", "d": "int"}) == dict.fromkeys("acd", False)


def test_edges_merge_in_any_order(spark):
    kind = "id string, src string, dst string, type string, weight double, confidence double, properties map<string,string>, seq int"
    rows = [("e", "a", "b", "t", 1.0, 0.5, {"x": "1", "y": "1"}, 0), ("e", "a", "b", "u", 3.0, 0.9, {"y": "2"}, 2), ("e", "q", "b", "t", 2.0, 0.7, {"z": None}, 1), ("f", "a", "c", "t", None, None, None, 5)]
    want = {"e": ("a", "b", "t", 3.0, 0.9, {"x": "1", "y": "2", "z": None}), "f": ("a", "c", "t", None, None, None)}
    for order in (rows, rows[::-1]):
        out = g.upsert_edges(spark.createDataFrame(order[:2], kind), spark.createDataFrame(order[2:], kind)).collect()
        assert {r.id: (r.src, r.dst, r.type, r.weight, r.confidence, r.properties) for r in out} == want


def test_learning_on_active_factors_alone(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    rows = [("p", f, d, 0.01 * (i + 1) * (j % 3 + 1)) for j, d in enumerate(days) for i, f in enumerate("abc")]
    returns = spark.createDataFrame(rows, "portfolio_id string, factor_id string, date date, ret double")
    catalogue = spark.createDataFrame([("a", "active"), ("b", "deprecated"), ("c", "active")], "factor_id string, status string")
    got = wt.learn_active(returns, catalogue, wt.ewma_step(), F.lit(7)).collect()
    plain = wt.learn(returns.where("factor_id <> 'b'"), wt.ewma_step()).collect()
    assert {(r.factor_id, r.date, r.weight) for r in got} == {(r.factor_id, r.date, r.weight) for r in plain}
    assert {r.learnt for r in got} == {7} and len(got) == 16
    assert wt.learn_active(returns, catalogue.where("status = 'none'"), wt.ewma_step(), F.lit(7)).count() == 0


def test_anywhere_walks_a_long_text_once(spark):
    """A text of 300 000 characters and small ones against a plain version; null stays null-safe."""
    import time

    lexicon = se.Lexicon(["the", "la", "a"], ["of", "der"], [], {"tion": 2.0, "ationa": -1.5}, {"in": 2.0, "on": 0.5, "xin": 3.0}, ["is", "d"], [])

    def plain(t):
        parts = []
        for p in range(len(t)):
            fits = sorted((w for w in lexicon.scores if t.startswith(w, p)), key=lambda w: (-len(w), w))
            if fits:
                degree = 1.0
                for d in sorted(lexicon.degrees, key=len):
                    degree = lexicon.degrees[d] if t[:p].endswith(d) else degree
                parts.append(lexicon.scores[fits[0]] * degree * (-1.0 if any(n in t[max(p - 2, 0) : p] for n in lexicon.negations) else 1.0))
        return max(min(sum(parts) / len(parts), 1), -1) if parts else 0.0

    texts = ["the nation", "is the xinla derational", "dla onthe", "", "zz", "𝔘𝔫the inla", "xinof the of is of " * 15_000]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string")
    began = time.time()
    got = {r.id: r.score for r in se.lexicon_sentiment(docs, "id", lexicon=lexicon, anywhere=True).collect()}
    assert time.time() - began < 60
    assert len(got) == 8
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t), abs=1e-9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_features_do_not_gather_their_rows(spark):
    """The marks of a feature go to its rows, or to shares of them; no task reads a whole feature."""
    from tidemark.operators import quality_features as qf

    rows = spark.createDataFrame([(float(i % 7), float(i)) for i in range(200)] + [(None, 5.0)], "x double, y double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bins = qf.histogram(rows, ["x", "y"])
        assert "BroadcastHashJoin" in plan_of(bins) and "SortMergeJoin" not in plan_of(bins)
        got = {(r.feature, r.bin): r.rows for r in bins.collect()}
        assert sum(n for (f, _), n in got.items() if f == "x") == 200 and got["y", 9] == 20
        for method in ("zscore", "iqr", "modified_zscore"):
            out = qf.outlier_rule(rows, ["x", "y"], method, 1.6)
            assert "__share" in plan_of(out)
            assert {r.feature: r["values"] for r in out.collect()} == {"x": 200, "y": 201}
        y = np.array([*map(float, range(200)), 5.0])
        odd = {r.feature: r.outliers for r in qf.outlier_rule(rows, ["x", "y"], "zscore", 1.6).collect()}
        assert odd["y"] == (np.abs(y - y.mean()) / y.std(ddof=1) > 1.6).sum()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cleaned_text_by_runs(spark):
    """Cleaning against Python's expressions, by runs of white space and of signs."""
    from tidemark.functions import text as tx

    texts = ["a  b", " a\tb ", "\x0b\x0b a\u0085b　c", "a b \r\n", "é‐–z 5%/$ -\"'", "中文 。、x", "", "   ", "a \n\n\n b\t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: (r.a, r.b) for r in docs.select("id", tx.clean_text(F.col("t")).alias("a"), tx.clean_text(F.col("t"), False).alias("b")).collect()}
    for i, t in enumerate(texts):
        one = re.sub(r"[ \t\n\x0b\f\r]+", " ", t)
        for kept, extra in zip(got[i], ("%$/", ""), strict=True):
            assert kept == re.sub(rf"[^一-龥a-zA-Z0-9{extra} \t\n\x0b\f\r.,;:!?()\[\]{{}}\"'-]", "", one).strip(" ")


def test_pairs_and_ids_are_dealt_into_as_many_parts(spark):
    """Both directions come of one merged pair; ids are shuffled by one number of parts for groupings and join."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("a", "a", 9.0), ("b", "c", 2.0), (None, "c", 1.0)], "src string, dst string, weight double")
    want = [("a", "b", 3.0), ("b", "a", 3.0), ("b", "c", 2.0), ("c", "b", 2.0)]
    for parts in (None, 7):
        adj = g.adjacency(edges, parts)
        assert sorted(map(tuple, adj.collect())) == want
    assert adj.rdd.getNumPartitions() == 7
    old = spark.createDataFrame([("e1", "a", "b", "t", 1.0, 1.0, {"k": "x"}, 0), ("e2", "b", "c", "t", 2.0, 1.0, {"k": "y"}, 0)], "id string, src string, dst string, type string, weight double, confidence double, properties map<string,string>, seq int")
    new = spark.createDataFrame([("e1", "a", "b", "u", 5.0, 0.5, {"m": "z"}, 1)], old.schema)
    out = g.upsert_edges(old, new, 7)
    plan = plan_of(out)
    assert plan.count("hashpartitioning(id") == plan.count(", 7)") == 2
    rows = lambda df: sorted((r.id, r.src, r.dst, r.type, r.weight, r.confidence, r.properties) for r in df.collect())
    assert rows(out) == rows(g.upsert_edges(old, new)) == [("e1", "a", "b", "t", 5.0, 0.5, {"k": "x", "m": "z"}), ("e2", "b", "c", "t", 2.0, 1.0, {"k": "y"})]


def test_extraction_bounds_what_a_worker_holds(spark):
    """Relations of texts go to Python in batches of bounded size; null and empty texts have no mentions."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "贵州茅台拥有招商银行"), (2, None), (3, ""), (4, "12.5%")], "doc_id long, text string")
    found = en.extract(docs, "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    got = {r.doc_id: r.entities and [m.text for m in r.entities] for r in found.collect()}
    assert got[2] is None and got[3] == [] and "12.5%" in got[4] and len(got[1]) >= 2
    assert {r.doc_id for r in rl.extract_relations(found, "doc_id").collect()} <= {1}


def test_learning_metrics_take_the_mean_of_the_factors(spark, tmp_path):
    """The query's portfolio return of a day is the mean over its factors, not the price's own return."""
    from tidemark.plans import state_queries as sq

    rng = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=45)
    lines = [(i, k, 1, float(q), float(q * x), d.to_pydatetime()) for k in (1, 2) for i, (d, q, x) in enumerate(zip(days, rng.integers(1, 50, 45), rng.uniform(5, 30, 45)))]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "B1"), (2, "B2")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.portfolio_id, r.date): r for r in sq.learning_metrics(spark, str(tmp_path)).collect()}
    rets = sq.factor_returns(spark, str(tmp_path)).toPandas()
    assert rets.factor_id.nunique() == 5
    seen = 0
    for name, daily in rets.groupby(["portfolio_id", "date"]).ret.mean().groupby(level=0):
        r = daily.droplevel(0).sort_index()
        path = (1 + r).cumprod()
        low = ((path - path.cummax()) / path.cummax()).cummin()
        for i, day in enumerate(r.index):
            row, past = got[name, day], r.iloc[: i + 1]
            assert row.hit_rate == pytest.approx((past > 0).mean(), abs=1e-6)
            assert row.max_drawdown == pytest.approx(low.iloc[i], abs=1e-5)
            assert row.sharpe == pytest.approx(past.mean() / past.std(ddof=0) if past.std(ddof=0) > 1e-12 else 0.0, abs=1e-4)
            seen += 1
    assert seen == len(got)


def test_closeness_by_sketch_two_ways(spark, monkeypatch):
    """Several parts, a hub and small parts of the graph: tasks that take all nodes and shares of the
    registers that are shuffled give the same rows; a hub's degree and small sets are exact."""
    from tidemark.operators import sketches

    monkeypatch.setattr(sketches, "LEAST_EDGES", 1500)
    monkeypatch.setattr(g, "SLOTS", 2)
    rng = np.random.default_rng(5)
    ends = [("hub", f"l{i}") for i in range(2000)] + [(f"t{i}", f"t{rng.integers(max(0, i - 300), i)}") for i in range(1, 900)]
    ends += [(f"p{i}", f"p{i + 1}") for i in range(5)] + [(f"c{i}", f"c{j}") for i in range(20) for j in range(i)]
    adj = g.adjacency(spark.createDataFrame([(*e, 1.0) for e in ends], "src string, dst string, weight double")).cache()
    alone = {r.node: (r.reachable, r.closeness) for r in g.closeness_by_sketch(adj).collect()}
    together = {r.node: (r.reachable, r.closeness) for r in g.closeness_by_sketch(adj, share_bytes=1).collect()}
    assert alone == together and len(alone) == 2001 + 900 + 6 + 20
    assert alone["hub"] == (2000, 1.0) and alone["p0"] == (5, 5 / 15) and alone["c7"] == (19, 1.0)
    assert alone["l1"][0] == pytest.approx(2000, rel=0.06) and alone["t0"][0] == pytest.approx(899, rel=0.06)
    adj.unpersist()
