"""Graph queries: strong trade between nations, and suppliers with their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import snap
from tidemark.operators import graph as g
from tidemark.plans.registry import query
from tidemark.plans.sql import snap as s
from tidemark.session import cut_lineage
from tidemark.sources.tables import table


def nation_edges(spark, folder):
    """Nation pairs that trade above the average; weight falls with the trade."""
    c = F.col
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, folder, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = table(spark, folder, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("a"))
    supp = table(spark, folder, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("b"))
    pairs = (
        lines.join(orders, "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey").where(c("a") != c("b"))
        .groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # a pair of nations is a row: a few hundred, read twice
    pairs = cut_lineage(pairs)
    strong = pairs.where(c("n") > pairs.agg((F.avg("n") * 1.1).alias("cut")).scalar())
    name = lambda k: F.concat(F.lit("N"), F.lpad(c(k).cast("string"), 2, "0"))
    return strong.select(name("x").alias("src"), name("y").alias("dst"), (1000.0 / c("n")).alias("weight"))


NATIONS = """pairs AS (SELECT least(c_nationkey, s_nationkey) AS x, greatest(c_nationkey, s_nationkey) AS y, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edges AS (SELECT concat('N', lpad(x::VARCHAR, 2, '0')) AS src, concat('N', lpad(y::VARCHAR, 2, '0')) AS dst, 1000.0::DOUBLE / n AS weight FROM pairs WHERE n > (SELECT avg(n) * 1.1 FROM pairs)),
adj AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nodes AS (SELECT src AS node, count(*) AS degree FROM adj GROUP BY 1)"""


LINES_A_TASK = 1_000_000


def supply_parts(spark, folder):
    """Partitions that hold a bounded number of lines each; the count is told by the file footers."""
    lines = table(spark, folder, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // LINES_A_TASK))


def supply_edges(spark, folder):
    """Supplier to part, weight = number of lines."""
    return (
        table(spark, folder, "lineitem")
        .select("l_suppkey", "l_partkey")
        .repartition(supply_parts(spark, folder), "l_suppkey", "l_partkey")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"),
            "weight",
        )
    )


def _supply(spark, folder):
    # grouped by supplier and part, and the letters keep the two apart: no pair occurs twice
    return g.adjacency(supply_edges(spark, folder), single=True)


SUPPLY = """edges AS (SELECT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2),
adj AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nodes AS (SELECT src AS node, count(*) AS degree FROM adj GROUP BY 1)"""


@query(
    "graph_degree",
    f"WITH {SUPPLY} SELECT node, degree, {s('degree::DOUBLE / ((SELECT count(*) FROM nodes) - 1)')} AS centrality FROM nodes",
)
def graph_degree(spark, folder):
    out = g.degree_centrality(_supply(spark, folder))
    return out.withColumn("centrality", snap(F.col("centrality")))


def _rounds(n: int, first: str, step: str, name: str) -> str:
    parts = [f"{name}0 AS MATERIALIZED ({first})"]
    parts += [f"{name}{i} AS MATERIALIZED ({step.format(p=f'{name}{i - 1}')})" for i in range(1, n + 1)]
    return ", ".join(parts)


RANK_TOLERANCE = 1e-2

_PR = f"""r AS (
    SELECT 0 AS it, node, degree, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank, 9.0::DOUBLE AS moved FROM nodes
    UNION ALL
    SELECT it + 1, node, degree, fresh, sum(abs(fresh - rank)) OVER () FROM (
      SELECT o.it, o.node, o.degree, o.rank, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * sum(p.rank / p.degree) AS fresh
      FROM r p JOIN adj ON adj.src = p.node JOIN r o ON o.node = adj.dst WHERE p.moved >= {RANK_TOLERANCE} GROUP BY 1, 2, 3, 4))"""


@query("graph_pagerank", f"WITH RECURSIVE {SUPPLY}, {_PR} SELECT node, {s('rank', 9)} AS rank FROM r WHERE it = (SELECT max(it) - 1 FROM r)")
def graph_pagerank(spark, folder):
    """Rounds until all ranks together move by less than the tolerance."""
    out = g.pagerank(_supply(spark, folder), tolerance=RANK_TOLERANCE)
    return out.select("node", snap(F.col("rank"), 9).alias("rank"))


_EV = """v AS (
    SELECT 0 AS it, node, 1.0::DOUBLE AS score, 9.0::DOUBLE AS moved FROM nodes
    UNION ALL
    SELECT it + 1, node, fresh, sum(abs(fresh - score)) OVER () FROM (
      SELECT it, node, score, raw / sqrt(sum(raw * raw) OVER ()) AS fresh FROM (
        SELECT o.it, o.node, o.score, sum(p.score) AS raw FROM v p JOIN adj ON adj.src = p.node JOIN v o ON o.node = adj.dst
        WHERE p.moved >= 1e-6 GROUP BY 1, 2, 3)))"""


@query("graph_eigenvector", f"WITH RECURSIVE {NATIONS}, {_EV} SELECT node, {s('score', 8)} AS score FROM v WHERE it = (SELECT max(it) - 1 FROM v)")
def graph_eigenvector(spark, folder):
    out = g.eigenvector_centrality(g.adjacency(nation_edges(spark, folder)))
    return out.select("node", snap(F.col("score"), 8).alias("score"))


def _dist(weight: str, name: str, n: int = 5) -> str:
    return _rounds(
        n,
        f"SELECT src AS a, dst AS b, {weight} AS d FROM adj UNION ALL SELECT node, node, 0.0::DOUBLE FROM nodes",
        "SELECT x.a, y.b, min(x.d + y.d) AS d FROM {p} x JOIN {p} y ON x.b = y.a GROUP BY 1, 2",
        name,
    )


@query(
    "graph_distances",
    f"WITH {NATIONS}, {_dist('weight', 'd')} SELECT a AS source, b AS node, {s('d')} AS distance FROM d5",
)
def graph_distances(spark, folder):
    out = g.distances(g.adjacency(nation_edges(spark, folder)))
    return out.select("source", "node", snap(F.col("distance")).alias("distance"))


@query(
    "graph_closeness",
    f"WITH {NATIONS}, {_dist('weight', 'd')} SELECT a AS node, {s('coalesce((count(*) - 1) / nullif(sum(d), 0), 0)')} AS closeness FROM d5 GROUP BY 1",
)
def graph_closeness(spark, folder):
    out = g.closeness_centrality(g.distances(g.adjacency(nation_edges(spark, folder))))
    return out.select("node", snap(F.col("closeness")).alias("closeness"))


@query("graph_closeness_by_sketch")
def graph_closeness_by_sketch(spark, folder):
    """All suppliers and parts; tested against exact distances."""
    return g.closeness_by_sketch(_supply(spark, folder))


_SIGMA = "s0 AS (SELECT node AS a, node AS b, 1.0::DOUBLE AS n FROM nodes), " + ", ".join(
    f"s{k} AS (SELECT s.a, adj.dst AS b, sum(s.n) AS n FROM s{k - 1} s JOIN adj ON adj.src = s.b JOIN u4 ON u4.a = s.a AND u4.b = adj.dst AND u4.d = {k} GROUP BY 1, 2)"
    for k in range(1, 7)
)


@query(
    "graph_betweenness",
    f"""WITH {NATIONS}, {_dist('1.0::DOUBLE', 'u', 4)}, {_SIGMA},
    sg AS ({' UNION ALL '.join(f'SELECT * FROM s{k}' for k in range(7))}),
    w AS (SELECT u4.a, u4.b, u4.d, sg.n FROM u4 JOIN sg ON u4.a = sg.a AND u4.b = sg.b),
    t AS (SELECT x.b AS node, sum(x.n * y.n / z.n) AS k FROM w x JOIN w y ON x.b = y.a JOIN w z ON z.a = x.a AND z.b = y.b
      WHERE x.d > 0 AND y.d > 0 AND x.a <> y.b AND x.d + y.d = z.d GROUP BY 1)
    SELECT nodes.node, {s('coalesce(k, 0) * 2.0 / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2))')} AS betweenness FROM nodes LEFT JOIN t USING (node)""",
)
def graph_betweenness(spark, folder):
    out = g.betweenness_centrality(g.adjacency(nation_edges(spark, folder)))
    return out.select("node", snap(F.col("betweenness")).alias("betweenness"))


@query(
    "graph_shortest_path",
    f"""WITH {NATIONS}, {_dist('weight', 'd')}, p1 AS (SELECT dst AS node, [(SELECT min(node) FROM nodes), dst] AS path, weight AS d FROM adj WHERE src = (SELECT min(node) FROM nodes)),
    {', '.join(f"p{k} AS (SELECT adj.dst AS node, list_append(p.path, adj.dst) AS path, p.d + adj.weight AS d FROM p{k - 1} p JOIN adj ON adj.src = p.node WHERE NOT list_contains(p.path, adj.dst) AND p.d + adj.weight <= (SELECT d FROM d5 WHERE a = (SELECT min(node) FROM nodes) AND b = (SELECT max(node) FROM nodes)) + 1e-9)" for k in range(2, 6))},
    al AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 6))})
    SELECT {s('d')} AS distance, array_to_string(path, '>') AS path FROM al WHERE node = (SELECT max(node) FROM nodes) ORDER BY al.d, al.path LIMIT 1""",
)
def graph_shortest_path(spark, folder):
    adj = g.adjacency(nation_edges(spark, folder))
    ends = g.nodes_of(adj).agg(F.min("node"), F.max("node")).first()
    out = g.shortest_path(adj, ends[0], ends[1])
    return out.select(snap(F.col("distance")).alias("distance"), F.array_join("path", ">").alias("path"))


_LP = """l AS (
    SELECT 0 AS it, node, node AS label, node AS before, 1 AS swung FROM nodes
    UNION ALL
    SELECT it + 1, node, fresh, label, least(sum((fresh <> label)::INT) OVER (), sum((fresh <> before)::INT) OVER ()) FROM (
      SELECT o.it, o.node, o.label, o.before, b.label AS fresh FROM l o JOIN (
        SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY k DESC, label) AS i FROM (
          SELECT adj.src AS node, p.label, count(*) AS k FROM adj JOIN l p ON adj.dst = p.node GROUP BY 1, 2)) b
      ON b.node = o.node AND b.i = 1 WHERE o.swung > 0))"""


@query("graph_label_propagation", f"WITH RECURSIVE {NATIONS}, {_LP} SELECT node, label FROM l WHERE it = (SELECT max(it) FROM l)")
def graph_label_propagation(spark, folder):
    return g.label_propagation(g.adjacency(nation_edges(spark, folder)))


@query("graph_local_moves")
def graph_local_moves(spark, folder):
    return g.local_moves(g.adjacency(nation_edges(spark, folder)))


@query(
    "graph_modularity",
    f"""WITH {NATIONS}, c AS (SELECT node, degree, substr(node, 2, 1) AS community FROM nodes), m AS (SELECT sum(degree) AS m2 FROM nodes)
    SELECT {s('sum(coalesce(w.weight, 0) - a.degree * b.degree / m2::DOUBLE) / any_value(m2)')} AS modularity
    FROM c a JOIN c b ON a.community = b.community AND a.node <> b.node LEFT JOIN adj w ON w.src = a.node AND w.dst = b.node, m""",
)
def graph_modularity(spark, folder):
    adj = g.adjacency(nation_edges(spark, folder))
    groups = g.nodes_of(adj).withColumn("community", F.substring("node", 2, 1))
    return g.modularity(adj, groups).select(snap(F.col("modularity")).alias("modularity"))


@query(
    "graph_components",
    f"WITH {SUPPLY}, {_rounds(6, 'SELECT node, node AS c FROM nodes', 'SELECT p.node, least(p.c, min(q.c)) AS c FROM {p} p JOIN adj ON adj.src = p.node JOIN {p} q ON q.node = adj.dst GROUP BY p.node, p.c', 'k')} SELECT node, c AS component FROM k6",
)
def graph_components(spark, folder):
    return g.connected_components(_supply(spark, folder))


@query(
    "graph_clustering",
    f"""WITH {NATIONS}, t AS (SELECT x.src AS node, count(*) / 2 AS triangles FROM adj x JOIN adj y ON x.src = y.src AND x.dst <> y.dst JOIN adj z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
    SELECT node, degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, {s('coalesce(coalesce(triangles, 0) / nullif(degree * (degree - 1) / 2, 0), 0)')} AS clustering FROM nodes LEFT JOIN t USING (node)""",
)
def graph_clustering(spark, folder):
    out = g.clustering(g.adjacency(nation_edges(spark, folder)))
    return out.withColumns({"clustering": snap(F.col("clustering")), "triangles": F.col("triangles").cast("bigint")})


@query(
    "graph_metrics",
    f"""WITH {NATIONS}, {_dist('weight', 'd')}, t AS (SELECT x.src AS node, count(*) / 2 AS triangles FROM adj x JOIN adj y ON x.src = y.src AND x.dst <> y.dst JOIN adj z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1),
    c AS (SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, avg(coalesce(coalesce(triangles, 0) / nullif(degree * (degree - 1) / 2, 0), 0)) AS clustering FROM nodes LEFT JOIN t USING (node)),
    k AS (SELECT count(DISTINCT m) AS components FROM (SELECT a, min(b) AS m FROM d5 GROUP BY 1)), f AS (SELECT CAST(floor(max(d)) AS INT) AS diameter, avg(d) AS average_path FROM d5 WHERE a <> b)
    SELECT nodes, edges, {s('clustering')} AS clustering, components, {s('2.0 * edges / (nodes * (nodes - 1))')} AS density, {s('2.0 * edges / nodes')} AS average_degree, diameter, {s('average_path')} AS average_path FROM c, k, f""",
)
def graph_metrics(spark, folder):
    adj = g.adjacency(nation_edges(spark, folder))
    out = g.graph_metrics(adj, g.distances(adj))
    return out.withColumns({c: snap(F.col(c)) for c in ("clustering", "density", "average_degree", "average_path")})


@query(
    "graph_k_hop",
    f"""WITH {NATIONS}, z AS (SELECT min(node) AS node FROM nodes), h1 AS (SELECT adj.dst AS node, 1 AS depth, max(weight) AS weight FROM adj JOIN z ON adj.src = z.node GROUP BY 1),
    h2 AS (SELECT adj.dst AS node, 2 AS depth, max(adj.weight) AS weight FROM adj JOIN h1 ON adj.src = h1.node WHERE adj.dst NOT IN (SELECT node FROM h1) AND adj.dst NOT IN (SELECT node FROM z) GROUP BY 1)
    SELECT node, depth, {s('weight')} AS weight FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)""",
)
def graph_k_hop(spark, folder):
    edges = nation_edges(spark, folder)
    start = edges.agg(F.least(F.min("src"), F.min("dst"))).first()[0]
    out = g.k_hop(edges, start, 2, limit=None)
    return out.select("node", "depth", snap(F.col("weight")).alias("weight"))


@query(
    "graph_simple_paths",
    f"""WITH {NATIONS}, p0 AS (SELECT min(node) AS node, [min(node)] AS path, 0.0::DOUBLE AS w FROM nodes),
    {', '.join(f"p{k} AS (SELECT adj.dst AS node, list_append(p.path, adj.dst) AS path, p.w + adj.weight AS w FROM p{k - 1} p JOIN adj ON adj.src = p.node WHERE NOT list_contains(p.path, adj.dst))" for k in range(1, 5))},
    al AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 5))})
    SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length, {s('w')} AS weight FROM al WHERE node = (SELECT max(node) FROM nodes) ORDER BY al.w DESC, al.path LIMIT 5""",
)
def graph_simple_paths(spark, folder):
    adj = g.adjacency(nation_edges(spark, folder))
    ends = g.nodes_of(adj).agg(F.min("node"), F.max("node")).first()
    out = g.simple_paths(adj, ends[0], ends[1])
    return out.select(F.array_join("path", ">").alias("path"), "length", snap(F.col("weight")).alias("weight"))


# --- node and edge tables -------------------------------------------------------------


def _tables(spark, folder):
    c = F.col
    s_ = table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("id"),
        F.lit("supplier").alias("type"),
        c("s_name").alias("name"),
        F.create_map(F.lit("balance"), c("s_acctbal").cast("string"), F.lit("nation"), c("s_nationkey").cast("string")).alias("properties"),
        F.array(F.lit("party")).alias("labels"),
        F.lit(0).alias("seq"),
    )
    edges = supply_edges(spark, folder).withColumn("type", F.when(c("weight") > 1, "repeat").otherwise("single"))
    return s_, edges


_T = f"{SUPPLY}, typed AS (SELECT *, CASE WHEN weight > 1 THEN 'repeat' ELSE 'single' END AS type FROM edges)"


@query(
    "graph_type_counts",
    f"WITH {_T} SELECT 'node' AS kind, 'supplier' AS type, count(*) AS rows FROM supplier UNION ALL SELECT 'edge', type, count(*) FROM typed GROUP BY type",
)
def graph_type_counts(spark, folder):
    return g.type_counts(*_tables(spark, folder))


@query(
    "graph_average_degree",
    f"WITH {_T} SELECT (SELECT count(*) FROM supplier) AS nodes, count(*) AS edges, {s('2 * count(*)::DOUBLE / (SELECT count(*) FROM supplier)')} AS average_degree FROM typed",
)
def graph_average_degree(spark, folder):
    return g.average_degree(*_tables(spark, folder)).withColumn("average_degree", snap(F.col("average_degree")))


@query("graph_find_edges", f"WITH {_T} SELECT type, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM typed WHERE type = 'repeat' AND weight >= 2 GROUP BY 1")
def graph_find_edges(spark, folder):
    found = g.find_edges(_tables(spark, folder)[1], "repeat", 2)
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").cast("long").alias("weight"))


@query(
    "graph_complete_nodes",
    "SELECT concat('S', s_suppkey) AS id, 'supplier' AS type FROM supplier UNION ALL SELECT DISTINCT concat('P', l_partkey), 'custom' FROM lineitem",
)
def graph_complete_nodes(spark, folder):
    return g.complete_nodes(*_tables(spark, folder)).select("id", "type")


@query(
    "graph_remove_nodes",
    f"WITH {_T} SELECT type, count(*) AS rows FROM typed WHERE src NOT IN (SELECT concat('S', s_suppkey) FROM supplier WHERE s_acctbal < 0) GROUP BY 1",
)
def graph_remove_nodes(spark, folder):
    nodes, edges = _tables(spark, folder)
    gone = nodes.where(F.col("properties")["balance"].cast("double") < 0)
    return g.remove_nodes(nodes, edges, gone)[1].groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "graph_neighbours",
    f"WITH {_T} SELECT DISTINCT src AS node FROM typed WHERE dst = 'P7'",
)
def graph_neighbours(spark, folder):
    return g.neighbours(_tables(spark, folder)[1], "P7", "both")


@query("graph_edges_between", f"WITH {_T} SELECT src, dst, weight, type FROM typed WHERE src = 'S7' AND dst = 'P7'")
def graph_edges_between(spark, folder):
    return g.edges_between(_tables(spark, folder)[1], "S7", "P7")


@query(
    "graph_subgraph",
    f"""WITH {_T}, i AS (SELECT concat('S', s_suppkey) AS id FROM supplier WHERE s_nationkey = 3), k AS (SELECT id FROM i UNION SELECT dst FROM typed WHERE src IN (SELECT id FROM i))
    SELECT src, count(*) AS edges FROM typed WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY 1""",
)
def graph_subgraph(spark, folder):
    nodes, edges = _tables(spark, folder)
    ids = nodes.where(F.col("properties")["nation"] == "3")
    return g.subgraph(edges, ids, with_neighbours=True).groupBy("src").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "graph_find_nodes",
    "SELECT concat('S', s_suppkey) AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), '0001') OR contains('0001', lower(s_name))",
)
def graph_find_nodes(spark, folder):
    return g.find_nodes(_tables(spark, folder)[0], "0001", "supplier", fuzzy=True).select("id", "name")


@query(
    "graph_upsert_nodes",
    """SELECT concat('S', s_suppkey) AS id, 'supplier' AS type, s_acctbal::VARCHAR = s_acctbal::VARCHAR AS kept, CASE WHEN s_nationkey < 10 THEN 'new' ELSE s_nationkey::VARCHAR END AS nation,
      CASE WHEN s_nationkey < 10 THEN 'checked,party' ELSE 'party' END AS labels FROM supplier""",
)
def graph_upsert_nodes(spark, folder):
    old, _ = _tables(spark, folder)
    new = old.where(F.col("properties")["nation"].cast("int") < 10).withColumns(
        {
            "properties": F.create_map(F.lit("nation"), F.lit("new")),
            "labels": F.array(F.lit("checked")),
            "seq": F.lit(1),
        }
    )
    out = g.upsert_nodes(old, new)
    return out.select(
        "id", "type", F.col("properties")["balance"].isNotNull().alias("kept"), F.col("properties")["nation"].alias("nation"), F.array_join("labels", ",").alias("labels")
    )


@query(
    "graph_upsert_edges",
    f"""WITH {_T} SELECT concat(src, '>', dst) AS id, src, dst, type, CASE WHEN weight > 1 THEN weight * 2 ELSE weight END AS weight, CASE WHEN weight > 1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
      type AS kind, CASE WHEN weight > 1 THEN 'yes' END AS checked FROM typed""",
)
def graph_upsert_edges(spark, folder):
    """Edges of more than one line come again, checked and heavier, under another type."""
    _, edges = _tables(spark, folder)
    old = edges.select(
        F.concat("src", F.lit(">"), "dst").alias("id"), "src", "dst", "type", "weight", F.lit(1.0).alias("confidence"),
        F.create_map(F.lit("kind"), F.col("type"), F.lit("checked"), F.lit(None).cast("string")).alias("properties"), F.lit(0).alias("seq"),
    )
    new = old.where(F.col("weight") > 1).withColumns(
        {
            "type": F.lit("other"), "weight": F.col("weight") * 2, "confidence": F.lit(0.9), "seq": F.lit(1),
            "properties": F.create_map(F.lit("checked"), F.lit("yes")),
        }
    )
    out = g.upsert_edges(old, new, supply_parts(spark, folder))
    return out.select(
        "id", "src", "dst", "type", "weight", "confidence", F.col("properties")["kind"].alias("kind"), F.col("properties")["checked"].alias("checked")
    )


@query(
    "graph_schema_errors",
    "SELECT concat('S', s_suppkey) AS id, CASE WHEN s_nationkey = 5 THEN 'unknown type' ELSE 'region' END AS errors FROM supplier",
)
def graph_schema_errors(spark, folder):
    nodes, _ = _tables(spark, folder)
    nodes = nodes.withColumn("type", F.when(F.col("properties")["nation"] == "5", "ghost").otherwise(F.col("type")))
    schema = spark.createDataFrame(
        [("supplier", "balance", "float"), ("supplier", "region", "string")], "type string, property string, value_type string"
    )
    return g.schema_errors(nodes, schema).select("id", F.array_join("errors", ",").alias("errors"))
