"""Packing, decontamination, near duplicates, classifier, url rules, shards and the pipeline against brute force."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontamination, near_dups, packing, quality_classifier, token_shards, url_filters
from tidemark.llm.queries import MODEL, QUERIES
from tidemark.llm.shared import word_hashes


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- packing


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_boundaries_are_best():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = rng.choice(40, rng.integers(1, 9), replace=False) + 1
        counts = rng.integers(1, 50, len(lengths))
        k = int(rng.integers(1, 5))
        got = packing.boundaries(lengths.tolist(), counts.tolist(), k)
        assert len(got) <= k and got == sorted(got) and got[-1] == max(lengths)
        every = (c for n in range(1, k + 1) for c in itertools.combinations(sorted(lengths), n) if c[-1] == max(lengths))
        assert padding(lengths, counts, got) == min(padding(lengths, counts, c) for c in every)


def test_packing_is_dense_and_whole(spark):
    rng = np.random.default_rng(7)
    made = [(i, int(n)) for i, n in enumerate(rng.integers(0, 260, 3000))] + [(None, 5)] * 40 + [(7, 9)] * 20
    lengths = spark.createDataFrame(made, "doc_id long, n_tokens long")
    rows = packing.pack(lengths, longest=100, buckets=4, budget=400).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.doc_id] += r.length
    want = defaultdict(int)
    for i, n in made:
        want[i] += n
    assert held == want
    batches = defaultdict(list)
    for r in rows:
        if r.upper is None:
            assert r.length == 0 and r.batch is None and r.slot is None
        else:
            assert 0 < r.length <= r.upper
            batches[r.upper, r.batch].append(r.slot)
    last = {u: max(b for v, b in batches if v == u) for u, _ in batches}
    for (upper, batch), slots in batches.items():
        full = max(1, 400 // upper)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= full
        assert batch == last[upper] or len(slots) == full
        assert len([b for u, b in batches if u == upper]) == last[upper] + 1
    counts = Counter(r.length for r in rows if r.length)
    assert sorted(last) == packing.boundaries(list(counts), list(counts.values()), 4)


def test_packing_awkward(spark, awkward, nothing):
    rows = packing.pack(awkward.withColumn("n_tokens", F.length("text"))).collect()
    assert {r.upper for r in rows if r.doc_id in (2, 3)} == {None}
    assert sum(r.length for r in rows if r.doc_id == 4) == 220_000
    assert packing.pack(nothing.withColumn("n_tokens", F.lit(1))).count() == 0


# --- decontamination


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def nearest(item, text):
    return min(plain_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, min(len(text), a + 2 * len(item)) + 1))


def test_best_window_is_best():
    rng = np.random.default_rng(8)
    for _ in range(150):
        item, text = rng.integers(0, 5, rng.integers(1, 8)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 14)).astype(np.uint64)
        distance, a, b = decontamination.best_window(item, text)
        assert distance == nearest(item.tolist(), text.tolist()) == plain_distance(item.tolist(), text[a:b].tolist())


def test_items_are_found_at_every_distance(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    pairs = items.orderBy("item_id").collect()
    held = decontamination.Items([r.item_id for r in pairs], [r.text for r in pairs], 0.2, 0.95, 3, 5)
    rng, hit, tried = np.random.default_rng(11), 0, 0
    for c in held.classes:
        for number, words, most in zip(c.numbers, c.words, c.most, strict=True):
            for edits in range(most + 1):
                text = np.concatenate((rng.integers(2**62, size=30).astype(np.uint64), decontamination.edited(words, edits, rng), rng.integers(2**62, size=30).astype(np.uint64)))
                starts, which = c.candidates(text, np.full(len(text), len(text)))
                out = [{}]
                held.verify(c, text, np.array([0, len(text)]), np.zeros(len(starts), int), starts, which, out)
                if number in out[0]:
                    a, b, distance = out[0][number]
                    assert distance <= edits and plain_distance(words.tolist(), text[a : b + 1].tolist()) == distance
                    hit += 1
                tried += 1
    assert hit >= 0.95 * tried


def test_matches_are_those_of_brute_force(spark, folder, docs):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.match_items(docs, items).collect()}
    texts = docs.orderBy("doc_id").collect()
    plain = lambda rows: [x.tolist() for x in np.split(*(lambda w, o: (w, o[1:-1]))(*word_hashes(pa.array([r.text for r in rows]))))]
    want = {}
    for r, text in zip(texts, plain(texts), strict=True):
        for item, words in zip(items.collect(), plain(items.collect()), strict=True):
            most = int(0.2 * len(words))
            if len(set(words) & set(text)) >= 0.6 * len(set(words)):
                distance = decontamination.best_window(np.array(words, np.uint64), np.array(text, np.uint64))[0]
                if distance <= most:
                    want[r.doc_id, item.item_id] = distance
    assert want and got == want


def test_items_in_several_sets_match_alike(spark, folder, docs, monkeypatch):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id): r.distance for r in decontamination.match_items(docs, items).collect()}
    left = {r.doc_id for r in decontamination.without_items(docs, items).collect()}
    words = items.agg(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))).first()[0]
    monkeypatch.setattr(decontamination, "ITEM_WORDS", words // 2)
    held, build = [], decontamination.Items
    monkeypatch.setattr(decontamination, "Items", lambda ids, *more: held.append(len(ids)) or build(ids, *more))
    rows = decontamination.match_items(docs, items).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == whole and len(rows) == len(whole)
    assert len(held) == 3 and sum(held) == items.count() and max(held) < items.count()
    assert {r.doc_id for r in decontamination.without_items(docs, items).collect()} == left


def test_decontamination_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "six seven eight nine ten"), (2, None), (3, ""), (4, "zwei"), (5, "ten nine")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.match_items(awkward, items).collect())
    assert got == {(1, 1): 2, (6, 4): 1}
    left = decontamination.without_items(awkward, items)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 3
    assert decontamination.match_items(nothing, items).count() == 0
    assert decontamination.without_items(awkward, items.limit(0)).count() == awkward.count()


# --- near duplicates


def shingles(text):
    plain = re.sub(r"[!-/:-@\[-`{-~]", "", text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), plain))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def classes(rows, least=0.8):
    """doc_id -> least id of its class, over all pairs that share a shingle."""
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            held[k].append(i)
    for a, b in {p for v in held.values() for p in itertools.combinations(v, 2)}:
        x, y = sets[a], sets[b]
        if sum((x & y).values()) >= least * sum((x | y).values()):
            root[find(b)] = find(a)
    for i, r in enumerate(rows):
        for j in range(i):
            if r.text is not None and r.text == rows[j].text:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r.doc_id)
    return {r.doc_id: min(members[find(i)]) for i, r in enumerate(rows)}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(12)
    cell = rng.integers(2**63, size=400).astype(np.uint64)
    k = 4000
    a, b = np.arange(0, 300), np.arange(100, 400)
    parts = rng.random(400)
    for part in (None, parts):
        pieces = np.concatenate((cell[a], cell[b]))
        text = np.repeat([0, 1], 300)
        weights = None if part is None else np.concatenate((part[a], part[b]))
        s = near_dups.dart_signatures(pieces, text, 3, k, weights)
        w = np.ones(400) if part is None else part
        assert abs((s[0] == s[1]).mean() - w[100:300].sum() / w.sum()) < 0.04
        assert (s[2] == 2**64 - 1).all()


def test_cells_count_repeats():
    cell, text = near_dups.cells(pa.array(["a b c d e a b c d e", "a b c d e", "a b", "", None, "A, b. C d e!"]))
    sets = [set(cell[text == i].tolist()) for i in range(6)]
    assert [len(s) for s in sets] == [6, 1, 1, 0, 0, 1]
    assert sets[1] == sets[5] and sets[1] < sets[0]


def test_classes_are_those_of_brute_force(spark, folder):
    small = folder.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r.class_id for r in QUERIES["op5_near_duplicates"](spark, small).collect()}
    assert got == classes(rows)
    assert len(set(got.values())) < len(got)


def test_chain_of_copies_is_one_class(spark):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    made = []
    for i in range(40):  # neighbours are near, the ends are far
        words[i * 3] = f"new{i}"
        made.append((i, " ".join(words)))
    made += [(100 + i, " ".join(f"z{x}" for x in rng.integers(0, 10**6, 50))) for i in range(20)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame).collect()}
    assert got == classes(frame.collect())
    assert {got[i] for i in range(40)} == {0}
    assert sorted(r.doc_id for r in near_dups.keep_first(frame).collect()) == [0, *range(100, 120)]


@pytest.mark.parametrize("block", [4, 384])
def test_spread_group_of_copies(spark, block):
    """Copies with few to many edits of one text: some meet only through others."""
    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    made = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            words[at] = f"e{rng.integers(10**6)}"
        made.append((i, " ".join(words)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    signatures = near_dups.written(near_dups.signed(frame, "doc_id", "text", 24, 5), "signed")
    roots = {r.node: r.root for r in near_dups.near_roots(frame, signatures, "text", 0.8, block).collect()}
    nodes = {r.id: r.node for r in signatures.collect()}
    want = classes(frame.collect())
    got = defaultdict(set)
    for i, node in nodes.items():
        got[roots.get(node, node)].add(i)
    members = defaultdict(set)
    for i, c in want.items():
        members[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, members.values()))
    assert 1 < len(members) < 60


def test_near_duplicates_awkward(awkward, nothing):
    rows = near_dups.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.class_id for r in rows if r.doc_id == 1} == {1}
    left = near_dups.keep_first(awkward)
    assert left.columns == awkward.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, None, None, 4, 5, 6])
    assert near_dups.near_duplicates(nothing).count() == 0 and near_dups.keep_first(nothing).count() == 0


def test_components(spark):
    rng = np.random.default_rng(14)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- quality classifier


def test_held_out_accuracy(spark, folder):
    small = folder.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = QUERIES["op6_quality_classifier"](spark, small)
    tested = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(tested) > 40
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.collect())


def test_held_out_labels_are_not_learned(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r.doc_id: round(r.score, 6) for r in quality_classifier.score_quality(docs, x).collect()}
    assert score(labels) == score(turned)


def test_risk_sums_are_plain(spark):
    rng = np.random.default_rng(15)
    x, positive, w = rng.normal(size=(50, 3)), rng.random(50) < 0.4, rng.normal(size=3)
    rows = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive, strict=True)], "x array<double>, positive boolean")
    z = x @ w
    s = 1 / (1 + np.exp(-z))
    want = np.concatenate(([50, positive.sum()], x[positive].sum(0), s @ x, s[positive] @ x[positive], np.einsum("n,ni,nj->ij", s * (1 - s), x, x).ravel()))
    assert quality_classifier.summed(rows, 20, quality_classifier.curvature(w)) == pytest.approx(want)
    soft = np.log1p(np.exp(z))
    assert quality_classifier.summed(rows, 3, quality_classifier.risks(w[None])) == pytest.approx([soft.sum(), soft[positive].sum(), z[positive].sum()])


def test_positive_unlabelled_weights_separate(spark):
    rng = np.random.default_rng(16)
    kind = rng.random(2000) < 0.7
    x = np.stack((np.ones(2000), rng.normal(size=2000) + np.where(kind, 2, -2)), 1)
    positive = kind & (rng.random(2000) < 0.3)
    rows = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive, strict=True)], "x array<double>, positive boolean")
    w = quality_classifier.fit(rows, 0.7)
    assert np.mean((x @ w > 0) == kind) > 0.95


def test_classifier_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (6, 1), (99, 1)], "doc_id long, quality int")
    rows = quality_classifier.score_quality(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    none = quality_classifier.score_quality(awkward, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.score_quality(nothing, labels).count() == 0
    left = quality_classifier.keep_quality(awkward, labels.limit(0))
    assert left.columns == awkward.columns and left.count() == awkward.count()
    assert quality_classifier.keep_quality(nothing, labels).count() == 0


# --- url rules


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_are_plain(spark, folder):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op7_url_filter"](spark, folder).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain_parts(urls[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")


def test_decisions_follow_links(spark):
    page = lambda i, url, html=None: (i, url, html)
    rows = [
        page(1, "http://x.net/fr/a"),  # block
        page(2, "https://alias.org/1", '<html><LINK href="http://x.net/fr/a" rel=canonical></html>'),
        page(3, "https://alias.org/1#top"),
        page(4, "http://alias.org:80/1/?utm_source=feed"),
        page(5, "https://far.org/2", "<meta http-equiv='refresh' content='0; url=//alias.org/1'>"),
        page(6, "https://y.org/3", '<link rel="canonical" href="http://z.net/es/b">'),
        page(7, "http://z.net/es/b", '<link rel="canonical" href="https://www.example.com/en/ok">'),  # block by its own rule
        page(8, "https://www.example.com/en/ok"),  # explicit allow
        page(9, "https://lone.org/4", '<link rel="stylesheet" href="http://x.net/fr/a">'),
        page(10, "https://rel.org/dir/page", '<link rel="canonical" href="other">'),
        page(11, "https://rel.org/dir/other", '<link rel="canonical" href="/root">'),
        page(12, "https://rel.org/root", '<link rel="canonical" href="http://x.net/fr/a">'),
        page(13, None, "<p>"),
        page(14, "no scheme"),
        page(15, "HTTP://Alias.ORG/1"),
        page(None, "http://x.net/fr/a"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("root", F.lit("r"))
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(frame).collect()}
    blocked = {i for i, v in got.items() if v == "block"}
    assert len(got) == len(rows)
    assert blocked == {1, 2, 3, 4, 5, 7, 10, 11, 12, 15, None}
    assert url_filters.filter_urls(frame.limit(0)).count() == 0
    same_as_sql(frame)


def test_links_are_decoded_and_all_taken(spark):
    rows = [(1, "http://x.net/fr/a?a=1&b=2", None)]  # block
    for i, sign in enumerate(("&amp;", "&#38;", "&#038;", "&#x26;", "&AMP;", "&"), 2):
        rows.append((i, f"https://a.org/{i}", f'<link rel="canonical" href="http://x.net/fr/a?a=1{sign}b=2{sign}utm_source=feed">'))
    rows += [
        (20, "https://b.org/1", '<!-- <link rel="canonical" href="/old"> --><link rel=canonical href="/older"><link rel="canonical" href="http://x.net/fr/a?a=1&amp;b=2">'),
        (21, "https://b.org/2", '<meta http-equiv=refresh content="9; url=/old2"><meta http-equiv="refresh" content="0;url=http:&#x2F;&#x2F;x.net/fr/a?a=1&amp;b=2">'),
        (22, "https://b.org/3", '<link rel="canonical" href="http://x.net/fr/a?a=1&amp;amp;b=2">'),  # names another url
        (23, "https://b.org/old", ""),
        (24, "https://b.org/older", ""),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(frame).collect()}
    # what a comment names is no alias
    assert {i for i, v in got.items() if v == "block"} == {*range(1, 8), 20, 21, 24}
    same_as_sql(frame)


def test_links_are_resolved_as_the_standard_says(spark):
    link = lambda href: f'<head><link data-href="/no" rel="canonical" href="{href}"></head>'
    rows = [
        (1, "http://x.net/fr/a", None), (2, "http://x.net/fr/b?page=2", None), (3, "http://x.net/fr/d/../c", None),  # block
        (10, "https://a.org/x/", link("/out?to=https://b.net/fr/q")), (11, "https://a.org/out?to=https://b.net/fr/q", None),
        (12, "https://c.org/p/q/r", link("../../fr")), (13, "https://c.org/fr", link("https://x.net/fr/./k/../a")),
        (14, "https://d.org/list", link("?page=2")), (15, "https://d.org/list?page=2", link("//x.net/fr/a#top")), (16, "https://d.org?page=2", None),
        (17, "https://e.org/1", link("mailto:fr@x.net")), (18, "https://e.org/2", link("ftp://x.net/fr/a")), (19, "https://e.org/3", link("#http://x.net/fr/a")),
        (20, "https://f.org/a", f"<!-- {link('http://x.net/fr/a')} --> <p> <!-- {link('http://x.net/fr/a')}"), (21, "https://f.org/%2E%2e/b/%2e", link("http://x.net/fr/%2e%2E/fr/c")), (22, "https://f.org/b", None),
        (23, "https://g.org/a", link("HTTP://X.NET/fr/a")), (23, "https://g.org/a", link("HTTP://X.NET/fr/a")), (None, None, link("http://x.net/fr/a")),
        (24, "https://h.org/" + "s/" * 20_000 + "../" * 20_000 + "end", "<p>" + "word " * 100_000 + link("http://x.net/fr/a")), (25, "https://h.org/end", None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = [(r.page_id, r.verdict) for r in url_filters.filter_urls(frame).collect()]
    assert len(told) == len(rows)
    assert {i for i, v in told if v == "block"} == {1, 2, 3, 12, 13, 14, 15, 21, 22, 23, 24, 25}
    same_as_sql(frame.where("coalesce(page_id, 0) < 24"))


def same_as_sql(frame):
    import duckdb

    con = duckdb.connect()
    con.register("pages", frame.select("page_id", "url", "html").toPandas())
    cur = con.execute(url_filters.filter_urls_sql())
    names = [d[0] for d in cur.description]
    want = Counter(tuple(None if x != x else x for x in row) for row in cur.fetchall())
    got = Counter(tuple(r[n] for n in names) for r in url_filters.filter_urls(frame).collect())
    assert got == want


def test_url_filter_matches_sql(spark, folder):
    same_as_sql(spark.read.parquet(f"{folder}/pages.parquet"))


# --- shards


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_feistel_is_a_permutation(size):
    slots = token_shards.feistel(np.arange(size), size, 5)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 60:
        assert (slots != token_shards.feistel(np.arange(size), size, 6)).any()
        assert abs(np.corrcoef(np.arange(size), slots)[0, 1]) < 0.3


def test_shards_hold_every_token_in_slot_order(spark, docs, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    index = token_shards.write_shards(docs.repartition(3), MODEL, str(tmp_path / "s"), length=128, per_shard=50).orderBy("slot").collect()
    assert [r.slot for r in index] == list(range(len(index)))
    assert all(r.offset == r.slot % 50 * 256 and r.shard == r.slot // 50 for r in index)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "s").iterdir())
    assert sizes[-1] == 50 * 256 and len(sizes) == -(-len(index) // 50) and sum(sizes) == len(index) * 256
    read = list(token_shards.read_slots((tmp_path / "s").as_uri(), 0, len(index), 128, 50))
    assert [x.tolist() for x in token_shards.read_slots((tmp_path / "s").as_uri(), 37, 61, 128, 50)] == [x.tolist() for x in read[37:98]]
    streams = defaultdict(list)
    for r, ids in sorted(zip(index, read, strict=True), key=lambda p: (p[0].part, p[0].seq)):
        streams[r.part].append(ids[: r.n_tokens])
        assert (ids[r.n_tokens :] == model.eos_id()).all()
    got = Counter()
    for parts in streams.values():
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == model.eos_id())
        assert ends[-1] == len(ids) - 1
        got.update(tuple(x[x != model.eos_id()].tolist()) for x in np.split(ids, ends + 1)[:-1])
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == Counter(tuple(x) for x in model.encode([t for t in texts.values() if t]) if x)
    assert {d for r in index for d in r.doc_ids} == {i for i, t in texts.items() if t and model.encode(t)}


def test_shards_awkward(awkward, nothing, tmp_path):
    index = token_shards.write_shards(awkward, MODEL, str(tmp_path / "a"), length=64).collect()
    told = [d for r in index for d in r.doc_ids]
    assert None in told and 2 not in told and 3 not in told and {1, 4, 6} <= set(told)
    assert token_shards.write_shards(nothing, MODEL, str(tmp_path / "b"), length=64).count() == 0


# --- pipeline


def test_pipeline_stages(spark, folder):
    import sentencepiece

    import corpus_pipeline as pipeline
    from tidemark.llm import secrets

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    folder = folder.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    columns, seen = docs.columns, {0: docs.collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1], 1):
        docs = pipeline.written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        seen[k] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert {labels[i] for i in ids[0] - ids[1] if i in labels} == {0}
    assert len([i for i in ids[1] if labels.get(i) == 1]) == len([i for i in ids[0] if labels.get(i) == 1])
    assert ids[2] == set(classes(seen[1]).values())
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in seen[2]}
    assert {i for i in ids[2] if any(x in texts[i] for x in items)} <= ids[2] - ids[3]
    assert ids[4] == ids[3] and len(seen[4]) == len(seen[3])
    for r in seen[4]:
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or secrets.base_spans(texts[r.doc_id])
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    held = defaultdict(int)
    for r in pipeline.STAGES[-1][1](spark, docs, folder).collect():
        held[r.doc_id] += r.length
    assert held == {r.doc_id: len(model.encode(r.text)) for r in seen[4]}


def test_every_dealt_query_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(i) for i in range(1, 14)}
