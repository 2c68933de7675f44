"""Queries on the graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import analytics, communities, components, vault
from quillgraph.plans.vault_queries import VIEWS
from quillgraph.session import cut
from quillgraph.sources.tables import table as t

#: Sources from which betweenness is estimated.
PIVOTS = 64


def _view(spark: SparkSession, d: str) -> DataFrame:
    return vault.edge_view(t(spark, d, "edges"))


def _digraph(spark: SparkSession, d: str) -> DataFrame:
    return analytics.simple_digraph(_view(spark, d))


def _all(spark: SparkSession, d: str) -> DataFrame:
    return vault.graph_nodes(t(spark, d, "nodes"), _view(spark, d)).select("node").distinct()


def _hubs(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    return vault.degrees(_view(spark, d)).orderBy(F.desc("degree"), "node").limit(k).select("node")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """All nodes with their names, null for ends of edges that no row describes."""
    own = vault.latest(t(spark, d, "nodes"), "name", "ingested_at").select(F.lower(F.trim("id")).alias("node"), "name")
    return _all(spark, d).join(own, "node", "left")


def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return analytics.density(_all(spark, d), _view(spark, d))


def top_relations(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_relations(_view(spark, d))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(_view(spark, d), "source", "target")


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(spark, d).groupBy("component").agg(F.count("*").alias("size"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pagerank(_all(spark, d), _digraph(spark, d)).select("node", F.round("rank", 9).alias("rank"))


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Hops from the three nodes of highest degree to all nodes that can be reached."""
    return analytics.distances(_digraph(spark, d), _hubs(spark, d)).select("source", "node", F.col("hops").cast("bigint").alias("hops"))


def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the nodes within two hops of the three nodes of highest degree."""
    return analytics.ego_graph(_digraph(spark, d), _hubs(spark, d), 2)[1].select("source", "target")


def betweenness_sample(spark: SparkSession, d: str) -> DataFrame:
    """Centrality, estimated by the ways from a sample of 64 nodes."""
    every = cut(_all(spark, d), "nodes")
    return analytics.betweenness(_digraph(spark, d), analytics.pivots(every, PIVOTS), every.count()).select("node", F.round("centrality", 6).alias("centrality"))


def hub_scores(spark: SparkSession, d: str) -> DataFrame:
    return analytics.hub_scores(analytics.pagerank(_all(spark, d), _digraph(spark, d)), vault.degrees(_view(spark, d)), betweenness_sample(spark, d), 20)


def graph_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return analytics.connectivity(_all(spark, d), connected_components(spark, d))


def path_narrative(spark: SparkSession, d: str) -> DataFrame:
    """The way between the last two nodes by key that have an edge, in words."""
    view = cut(_view(spark, d), "view")
    last = [r.node for r in vault.degrees(view).orderBy(F.desc("node")).limit(2).collect()]
    return analytics.path_narrative(view, _names(spark, d), last[-1], last[0])


def suggested_questions(spark: SparkSession, d: str) -> DataFrame:
    return analytics.suggested_questions(surprising_connections(spark, d), hub_scores(spark, d), t(spark, d, "communities"), _names(spark, d))


def surprising_connections(spark: SparkSession, d: str) -> DataFrame:
    return analytics.surprising_connections(_view(spark, d), vault.community_members(t(spark, d, "communities")), 50)


def undirected_collapse(spark: SparkSession, d: str) -> DataFrame:
    return communities.weighted_pairs(_view(spark, d)).select("u", "v", F.round("w", 4).alias("w"))


def community_detection(spark: SparkSession, d: str) -> DataFrame:
    return communities.detect(communities.weighted_pairs(_view(spark, d)))


def community_levels(spark: SparkSession, d: str) -> DataFrame:
    pairs = communities.weighted_pairs(_view(spark, d))
    return communities.split_large(pairs, communities.detect(pairs), 2)


def community_table(spark: SparkSession, d: str) -> DataFrame:
    pairs = cut(communities.weighted_pairs(_view(spark, d)), "pairs")
    labels = cut(communities.detect(pairs), "labels")
    return communities.community_table(_all(spark, d), labels, cut(communities.split_large(pairs, labels, 2), "parts"))


def stored_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the stored communities over the edges among their nodes."""
    labels = vault.latest(t(spark, d, "nodes"), "community_id", "ingested_at").where("community_id IS NOT NULL").select(F.lower(F.trim("id")).alias("node"), F.col("community_id").alias("community"))
    pairs = communities.weighted_pairs(_view(spark, d)).join(labels.select(F.col("node").alias("u")), "u", "left_semi").join(labels.select(F.col("node").alias("v")), "v", "left_semi")
    return communities.modularity(pairs, labels)


QUERIES = {f.__name__: f for f in (graph_density, top_relations, connected_components, component_sizes, pagerank, shortest_paths, ego_graph, betweenness_sample, hub_scores, graph_connectivity, path_narrative, suggested_questions, surprising_connections, undirected_collapse, community_detection, community_levels, community_table, stored_modularity)}

_W = f"WITH RECURSIVE {VIEWS}"
_G = """
alln AS (SELECT DISTINCT lower(trim(id)) AS node FROM node_l UNION SELECT source FROM edge_v WHERE source IS NOT NULL UNION SELECT target FROM edge_v WHERE target IS NOT NULL),
dg AS (SELECT v.source, v.target, arg_max(v.weight, (l.ingested_at, v.id)) AS weight FROM edge_v v JOIN edge_l l USING (id) WHERE v.source IS NOT NULL AND v.target IS NOT NULL GROUP BY v.source, v.target),
ud AS (SELECT source AS u, target AS v FROM dg WHERE source <> target UNION SELECT target, source FROM dg WHERE source <> target),
deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edge_v UNION ALL SELECT target FROM edge_v) WHERE node IS NOT NULL GROUP BY node),
seed AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 3)"""
_REACH = "walk AS (SELECT node AS source, node, 0 AS hops FROM seed UNION SELECT w.source, u.v, w.hops + 1 FROM walk w JOIN ud u ON u.u = w.node WHERE w.hops < {most}), dist AS (SELECT source, node, min(hops)::BIGINT AS hops FROM walk GROUP BY source, node)"
_PATH = """
two AS (SELECT (SELECT node FROM deg ORDER BY node DESC LIMIT 1 OFFSET 1) AS a, (SELECT max(node) FROM deg) AS b),
back AS (SELECT b AS node, 0 AS hops FROM two UNION SELECT u.v, w.hops + 1 FROM back w JOIN ud u ON u.u = w.node WHERE w.hops < 40),
far AS (SELECT node, min(hops) AS hops FROM back GROUP BY node),
way AS (SELECT a AS node, (SELECT hops FROM far WHERE node = a) AS left_, 0 AS i FROM two UNION ALL SELECT min(u.v), any_value(w.left_) - 1, any_value(w.i) + 1 FROM way w JOIN ud u ON u.u = w.node JOIN far f ON f.node = u.v AND f.hops = w.left_ - 1 GROUP BY w.i),
said AS (SELECT x.i, arg_min(v.predicate, (v.source <> x.node, v.id)) AS p FROM way x JOIN way y ON y.i = x.i + 1 JOIN edge_v v ON (v.source = x.node AND v.target = y.node) OR (v.source = y.node AND v.target = x.node) GROUP BY x.i)
SELECT (SELECT a FROM two) AS source, (SELECT b FROM two) AS target, true AS found, count(*) - 1 AS hops, string_agg(CASE WHEN w.i > 0 THEN ' --[' || coalesce(p, 'CONNECTED_TO') || ']--> ' ELSE '' END || coalesce(n.name, w.node), '' ORDER BY w.i) AS narrative FROM way w LEFT JOIN said s ON s.i + 1 = w.i LEFT JOIN node_l n ON lower(trim(n.id)) = w.node"""
_CC = "lab AS (SELECT u AS node, u AS c FROM ud UNION SELECT u.v, l.c FROM lab l JOIN ud u ON u.u = l.node WHERE l.c < u.v), cc AS (SELECT node, min(c) AS component FROM lab GROUP BY node)"


def _pagerank_sql(rounds: int = 48, every: int = 3) -> str:
    """Rounds without what dangling nodes give to all; the first that is checked and changes little is scaled to 1."""
    parts = ["sh AS MATERIALIZED (SELECT e.source, e.target, e.weight / o.total AS share FROM dg e JOIN (SELECT source, sum(weight) AS total FROM dg GROUP BY source HAVING total > 0) o USING (source)), nn AS (SELECT count(*)::DOUBLE AS n FROM alln), r0 AS MATERIALIZED (SELECT node, 1 / n AS rank FROM alln, nn)"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT a.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(c.came, 0) AS rank FROM alln a CROSS JOIN nn LEFT JOIN (SELECT s.target AS node, sum(x.rank * s.share) AS came FROM sh s JOIN r{i - 1} x ON x.node = s.source GROUP BY s.target) c ON c.node = a.node)")
    checked = range(every, rounds + 1, every)
    parts.append("er AS (" + " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.rank - b.rank)) AS e FROM r{i} a JOIN r{i - 1} b USING (node)" for i in checked) + ")")
    parts.append("done AS (SELECT min(i) AS i FROM er, nn WHERE e < 1e-6 * n)")
    parts.append("pr AS (" + " UNION ALL ".join(f"SELECT node, rank FROM r{i} WHERE {i} = (SELECT i FROM done)" for i in checked) + ")")
    return ", ".join(parts)


ORACLE = {
    "graph_density": f"{_W}, {_G} SELECT n AS nodes, m AS edges, round(CASE WHEN n > 1 THEN m / (n * (n - 1))::DOUBLE ELSE 0 END, 6) AS density FROM (SELECT (SELECT count(*) FROM alln) AS n, (SELECT count(*) FROM edge_v) AS m)",
    "top_relations": f"{_W} SELECT predicate, count(*) AS n FROM edge_v GROUP BY predicate ORDER BY n DESC, predicate LIMIT 6",
    "connected_components": f"{_W}, {_G}, {_CC} SELECT * FROM cc",
    "component_sizes": f"{_W}, {_G}, {_CC} SELECT component, count(*) AS size FROM cc GROUP BY component",
    "pagerank": f"{_W}, {_G}, {_pagerank_sql()} SELECT node, round(rank / (SELECT sum(rank) FROM pr), 9) AS rank FROM pr",
    "graph_connectivity": f"{_W}, {_G}, {_CC} SELECT count(*) AS nodes, count(DISTINCT coalesce(component, node)) AS components, count(DISTINCT coalesce(component, node)) = 1 AS connected FROM alln LEFT JOIN cc USING (node)",
    "path_narrative": f"{_W}, {_G}, {_PATH}",
    "shortest_paths": f"{_W}, {_G}, {_REACH.format(most=40)} SELECT * FROM dist",
    "ego_graph": f"{_W}, {_G}, {_REACH.format(most=2)} SELECT source, target FROM dg WHERE source IN (SELECT node FROM dist) AND target IN (SELECT node FROM dist)",
    "surprising_connections": f"{_W}, o AS (SELECT node, arg_max(id, (level, id)) AS c FROM member GROUP BY node) SELECT v.id, v.source, v.target, v.predicate, a.c AS c_source, b.c AS c_target FROM edge_v v JOIN o a ON a.node = v.source JOIN o b ON b.node = v.target WHERE a.c <> b.c AND a.c <> 0 AND b.c <> 0 ORDER BY v.id LIMIT 50",
    "undirected_collapse": f"{_W} SELECT least(source, target) AS u, greatest(source, target) AS v, round(sum(weight), 4) AS w FROM edge_v WHERE source <> target GROUP BY 1, 2",
    "stored_modularity": f"{_W}, lb AS (SELECT lower(trim(id)) AS node, community_id AS c FROM node_l WHERE community_id IS NOT NULL), pr AS (SELECT least(source, target) AS u, greatest(source, target) AS v, sum(weight) AS w FROM edge_v WHERE source <> target AND source IN (SELECT node FROM lb) AND target IN (SELECT node FROM lb) GROUP BY 1, 2), e AS (SELECT w, a.c AS cu, b.c AS cv FROM pr JOIN lb a ON a.node = u JOIN lb b ON b.node = v), k AS (SELECT c, sum(w) AS k FROM (SELECT cu AS c, w FROM e UNION ALL SELECT cv, w FROM e) GROUP BY c), i AS (SELECT cu AS c, sum(w) AS inside FROM e WHERE cu = cv GROUP BY cu), m AS (SELECT sum(w) AS m FROM pr) SELECT count(*) AS communities, round(sum(coalesce(inside, 0) / m - (k / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN i USING (c), m",
}
