"""Queries on views of the stored tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import vault
from quillgraph.sources.tables import table as t

#: Common table expressions that the SQL below shares.
VIEWS = r"""
note_l AS (SELECT * FROM notes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
chunk_l AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
node_l AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
edge_l AS (SELECT * FROM edges WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
gone_note AS (SELECT DISTINCT lower(trim(id)) AS note FROM note_l WHERE deleted_at IS NOT NULL),
gone_chunk AS (SELECT DISTINCT lower(trim(id)) AS chunk FROM chunk_l WHERE lower(trim(note_id)) IN (SELECT note FROM gone_note)),
node_p AS (SELECT DISTINCT id, chunk FROM (SELECT id, lower(trim(unnest(string_split_regex(regexp_replace(provenance, '[\[\]"'']', '', 'g'), '[,;]')))) AS chunk FROM node_l) WHERE chunk <> ''),
edge_p AS (SELECT DISTINCT id, chunk FROM (SELECT id, lower(trim(unnest(string_split_regex(regexp_replace(provenance, '[\[\]"'']', '', 'g'), '[,;]')))) AS chunk FROM edge_l) WHERE chunk <> ''),
node_s AS (SELECT n.id, count(p.chunk) AS n_before, count(p.chunk) FILTER (WHERE p.chunk NOT IN (SELECT chunk FROM gone_chunk)) AS n_left FROM node_l n LEFT JOIN node_p p USING (id) GROUP BY n.id),
edge_s AS (SELECT e.id, count(p.chunk) AS n_before, count(p.chunk) FILTER (WHERE p.chunk NOT IN (SELECT chunk FROM gone_chunk)) AS n_left FROM edge_l e LEFT JOIN edge_p p USING (id) GROUP BY e.id),
node_a AS (SELECT * FROM node_s WHERE n_before = 0 OR n_left > 0),
edge_v AS (SELECT id, nullif(lower(trim(source)), '') AS source, nullif(lower(trim(target)), '') AS target, predicate, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0::DOUBLE ELSE weight END AS weight, CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0::DOUBLE ELSE confidence END AS confidence, coalesce(weight, 0) <> 0 AS weighted FROM edge_l),
edge_a AS (SELECT v.id, v.source, v.target, v.predicate, v.weight, v.confidence, s.n_left FROM edge_v v JOIN edge_s s USING (id) WHERE (s.n_before = 0 OR s.n_left > 0) AND v.source IN (SELECT lower(trim(id)) FROM node_a) AND v.target IN (SELECT lower(trim(id)) FROM node_a)),
lost AS (SELECT DISTINCT lower(trim(id)) AS node FROM node_s WHERE NOT (n_before = 0 OR n_left > 0)),
edge_k AS (SELECT v.id, v.source, v.target FROM edge_v v JOIN edge_s s USING (id) WHERE (s.n_before = 0 OR s.n_left > 0) AND coalesce(v.source, '') NOT IN (SELECT node FROM lost) AND coalesce(v.target, '') NOT IN (SELECT node FROM lost)),
member AS (SELECT id, level, parent_id, lower(trim(unnest(from_json(node_ids, '["VARCHAR"]')))) AS node, unnest(range(len(from_json(node_ids, '["VARCHAR"]')))) AS pos FROM communities),
community_a AS (SELECT id, level, count(*) AS n_members, count(*) FILTER (WHERE node IN (SELECT lower(trim(id)) FROM node_a)) AS n_active FROM member GROUP BY id, level HAVING n_active > 0)
"""


def _v(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(t(spark, d, n) for n in ("nodes", "edges", "communities", "chunks", "notes"))


def soft_deleted_chunks(spark: SparkSession, d: str) -> DataFrame:
    return vault.deleted_chunks(t(spark, d, "chunks"), t(spark, d, "notes"))


def active_nodes(spark: SparkSession, d: str) -> DataFrame:
    return vault.active_nodes(t(spark, d, "nodes"), t(spark, d, "chunks"), t(spark, d, "notes"))


def active_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _, chunks, notes = _v(spark, d)
    return vault.active_edges(edges, nodes, chunks, notes)


def active_communities(spark: SparkSession, d: str) -> DataFrame:
    return vault.active_communities(t(spark, d, "communities"), active_nodes(spark, d))


def cascade_purge_counts(spark: SparkSession, d: str) -> DataFrame:
    return vault.purge_counts(*_v(spark, d))


def purged_notes(spark: SparkSession, d: str) -> DataFrame:
    return vault.purge(*_v(spark, d))["notes"].select("id").distinct()


def purged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return vault.purge(*_v(spark, d))["nodes"]


def purged_edges(spark: SparkSession, d: str) -> DataFrame:
    return vault.purge(*_v(spark, d))["edges"]


def purged_communities(spark: SparkSession, d: str) -> DataFrame:
    return vault.purge(*_v(spark, d))["communities"]


def node_search(spark: SparkSession, d: str) -> DataFrame:
    return vault.node_search(t(spark, d, "nodes"), "vector", 25)


def edges_incident(spark: SparkSession, d: str) -> DataFrame:
    hubs = vault.node_search(t(spark, d, "nodes"), "vector", 25).select(F.lower(F.trim("id")).alias("node"))
    return vault.incident_edges(vault.edge_view(t(spark, d, "edges")), hubs)


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return vault.graph_nodes(t(spark, d, "nodes"), vault.edge_view(t(spark, d, "edges")))


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return vault.degrees(vault.edge_view(t(spark, d, "edges")))


def degree_purge_rule(spark: SparkSession, d: str) -> DataFrame:
    return vault.degrees(active_edges(spark, d), loops_twice=False)


def notes_latest(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest(t(spark, d, "notes"), "title", "source_type", "deleted_at", "ingested_at").select("id", "title", F.lower(F.trim("source_type")).alias("source_type"), F.col("deleted_at").isNotNull().alias("deleted"))


QUERIES = {f.__name__: f for f in (soft_deleted_chunks, active_nodes, active_edges, active_communities, cascade_purge_counts, purged_notes, purged_nodes, purged_edges, purged_communities, node_search, edges_incident, graph_nodes, node_degree, degree_purge_rule, notes_latest)}
_SEARCH = "SELECT id, name, coalesce(degree, 0)::BIGINT AS degree FROM node_l WHERE contains(lower(name), 'vector') OR contains(lower(coalesce(description, '')), 'vector') ORDER BY degree DESC, id LIMIT 25"
_SQL = {
    "soft_deleted_chunks": "SELECT chunk FROM gone_chunk",
    "active_nodes": "SELECT id, n_before, n_left FROM node_a",
    "active_edges": "SELECT id, source, target, predicate, weight, n_left FROM edge_a",
    "active_communities": "SELECT * FROM community_a",
    "cascade_purge_counts": "SELECT 'notes' AS what, (SELECT count(*) FROM gone_note) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM gone_chunk) UNION ALL SELECT 'nodes', (SELECT count(*) FROM node_l WHERE id NOT IN (SELECT id FROM node_a)) UNION ALL SELECT 'edges', (SELECT count(*) FROM edge_l WHERE id NOT IN (SELECT id FROM edge_k)) UNION ALL SELECT 'communities', (SELECT count(DISTINCT id) FROM communities WHERE id NOT IN (SELECT id FROM member WHERE node NOT IN (SELECT node FROM lost)))",
    "purged_notes": "SELECT DISTINCT id FROM notes WHERE id IS NOT NULL AND lower(trim(id)) NOT IN (SELECT note FROM gone_note)",
    "purged_nodes": "SELECT a.id, coalesce(l.p, '[]') AS provenance, coalesce(g.n, 0) AS degree FROM node_a a LEFT JOIN (SELECT id, '[\"' || string_agg(chunk, '\",\"' ORDER BY chunk) || '\"]' AS p FROM node_p WHERE chunk NOT IN (SELECT chunk FROM gone_chunk) GROUP BY id) l USING (id) LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT id, source AS node FROM edge_k UNION SELECT id, target FROM edge_k) WHERE node IS NOT NULL GROUP BY node) g ON g.node = lower(trim(a.id))",
    "purged_edges": "SELECT k.id, k.source, k.target, coalesce(l.p, '[]') AS provenance FROM edge_k k LEFT JOIN (SELECT id, '[\"' || string_agg(chunk, '\",\"' ORDER BY chunk) || '\"]' AS p FROM edge_p WHERE chunk NOT IN (SELECT chunk FROM gone_chunk) GROUP BY id) l USING (id)",
    "purged_communities": "SELECT id, '[\"' || string_agg(node, '\",\"' ORDER BY pos) || '\"]' AS node_ids FROM member WHERE node NOT IN (SELECT node FROM lost) GROUP BY id",
    "node_search": _SEARCH,
    "edges_incident": f"SELECT id, source, target, predicate, weight FROM edge_v WHERE source IN (SELECT lower(trim(id)) FROM ({_SEARCH})) OR target IN (SELECT lower(trim(id)) FROM ({_SEARCH}))",
    "graph_nodes": "SELECT lower(trim(id)) AS node, upper(trim(coalesce(type, 'CONCEPT'))) AS type, false AS ghost FROM node_l UNION ALL SELECT DISTINCT e, 'CONCEPT', true FROM (SELECT source AS e FROM edge_v UNION SELECT target FROM edge_v) WHERE e IS NOT NULL AND e NOT IN (SELECT lower(trim(id)) FROM node_l)",
    "node_degree": "SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edge_v UNION ALL SELECT target FROM edge_v) WHERE node IS NOT NULL GROUP BY node",
    "degree_purge_rule": "SELECT node, count(*) AS degree FROM (SELECT id, source AS node FROM edge_a UNION SELECT id, target FROM edge_a) GROUP BY node",
    "notes_latest": "SELECT id, title, lower(trim(source_type)) AS source_type, deleted_at IS NOT NULL AS deleted FROM note_l",
}
ORACLE = {k: f"WITH {VIEWS} {v}" for k, v in _SQL.items()}
