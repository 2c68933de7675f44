"""Queries on classification, listings, exports, layout and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import classify, vault
from quillgraph.operators import vault_reports as reports
from quillgraph.plans.text_queries import _TRIM
from quillgraph.plans.vault_queries import VIEWS
from quillgraph.sources.tables import table as t
from quillgraph.streaming import events


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest(t(spark, d, "nodes"), "name", "type", "description", "degree", "community_id", "layout_x", "layout_y", "ingested_at")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest_texts(t(spark, d, "notes"), "title", "tags", "raw_content", "deleted_at", "ingested_at").where("deleted_at IS NULL")


def _view(spark: SparkSession, d: str) -> DataFrame:
    return vault.edge_view(t(spark, d, "edges"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents")


def classify_topics(spark: SparkSession, d: str) -> DataFrame:
    return classify.topic_scores(_docs(spark, d), "doc_id", "text")


def classify_tone(spark: SparkSession, d: str) -> DataFrame:
    return classify.tone(_docs(spark, d), "doc_id", "text")


def auto_tags(spark: SparkSession, d: str) -> DataFrame:
    return classify.auto_tags(classify_topics(spark, d), classify_tone(spark, d))


def prominent_terms(spark: SparkSession, d: str) -> DataFrame:
    return classify.prominent_terms(_docs(spark, d), "doc_id", "text")


def note_listing(spark: SparkSession, d: str) -> DataFrame:
    return reports.note_listing(_notes(spark, d), vault.provenance(t(spark, d, "nodes")))


def gallery_search(spark: SparkSession, d: str) -> DataFrame:
    return reports.gallery_search(_notes(spark, d), "pipeline")


def content_keys(spark: SparkSession, d: str) -> DataFrame:
    return reports.content_keys(vault.latest_texts(t(spark, d, "notes"), "raw_content", "ingested_at"))


def conversation_window(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve events of every user."""
    rows = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return reports.last_messages(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "place")


def history_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "props")
    return reports.history(rows, "user_id", ["ts", "event_id"], F.concat_ws(": ", F.initcap("event_type"), "props"))


def export_turtle(spark: SparkSession, d: str) -> DataFrame:
    return reports.turtle(_nodes(spark, d), _view(spark, d))


def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return reports.flat_records(_nodes(spark, d), _view(spark, d))


def export_jsonld(spark: SparkSession, d: str) -> DataFrame:
    return reports.linked_data(_nodes(spark, d))


def export_elements(spark: SparkSession, d: str) -> DataFrame:
    return reports.drawn_elements(_nodes(spark, d), _view(spark, d))


def export_digest(spark: SparkSession, d: str) -> DataFrame:
    return reports.digest(_nodes(spark, d), _view(spark, d), t(spark, d, "communities"))


def export_notes(spark: SparkSession, d: str) -> DataFrame:
    return reports.exported_notes(_notes(spark, d))


def vector_metadata(spark: SparkSession, d: str) -> DataFrame:
    return reports.vector_metadata(t(spark, d, "embeddings"))


def layout_nearest(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return reports.nearest(nodes, nodes.where(F.expr("try_cast(substr(id, 2) AS bigint)") % 50 == 0), 40.0)


def normalize_layout(spark: SparkSession, d: str) -> DataFrame:
    return reports.normal_layout(_nodes(spark, d))


def spiral_layout(spark: SparkSession, d: str) -> DataFrame:
    degrees = vault.graph_nodes(t(spark, d, "nodes"), _view(spark, d)).select("node").join(vault.degrees(_view(spark, d)), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    return reports.spiral_layout(degrees, leaf=5)


def layout_neighbours(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return reports.neighbours_within(nodes, nodes.where(F.expr("try_cast(substr(id, 2) AS bigint)") % 50 == 0), 40.0)


def node_style(spark: SparkSession, d: str) -> DataFrame:
    return reports.node_style(_nodes(spark, d))


def edge_rest_lengths(spark: SparkSession, d: str) -> DataFrame:
    view = _view(spark, d)
    return reports.rest_lengths(view, vault.degrees(view))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(t(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(t(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (classify_topics, classify_tone, auto_tags, prominent_terms, note_listing, gallery_search, content_keys, conversation_window, history_prompt, export_turtle, export_csv, export_jsonld, export_elements, export_digest, export_notes, vector_metadata, normalize_layout, spiral_layout, layout_neighbours, layout_nearest, node_style, edge_rest_lengths, event_windows, event_sessions)
}

_PLAIN = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}]', '-', 'g'), '[^\x00-\x7F]', '_', 'g')"
_COUNT = lambda p: f"len(regexp_extract_all(low, '{p}'))"


def _topics_sql() -> str:
    parts = []
    for name in classify.TOPICS:
        single, phrases = classify.single_words(name), classify.phrases_of(name)
        more = f" + 2 * {_COUNT('|'.join(phrases))}" if phrases else ""
        shown = "array_to_string(list_concat([]::VARCHAR[], [" + ", ".join(f"CASE WHEN {'contains(low, ' + chr(39) + w + chr(39) + ')' if w in phrases else 'regexp_matches(low, ' + chr(39) + classify.word_pattern([w]) + chr(39) + ')'} THEN '{w}' END" for w in classify.TOPICS[name]) + "]), ', ')"
        parts.append(f"SELECT doc_id AS id, '{name}' AS topic, ({_COUNT(classify.word_pattern(single))}{more})::DOUBLE AS score, {shown} AS matched FROM src")
    return f"src AS (SELECT doc_id, lower({_PLAIN}) AS low FROM documents WHERE text IS NOT NULL), raw AS ({' UNION ALL '.join(parts)}), tot AS (SELECT id, sum(score) AS total FROM raw GROUP BY id), tp AS (SELECT id, topic, score, round(score / total * 100, 1) AS percent, matched FROM raw JOIN tot USING (id) WHERE score > 0 UNION ALL SELECT id, 'General', 1.0::DOUBLE, 100.0::DOUBLE, '' FROM tot WHERE total = 0)"


_ANY = lambda ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"
_TONE = f"""tn AS (SELECT doc_id AS id, len(regexp_extract_all(plain, '[A-Za-z0-9_-]*[A-Za-z0-9_][A-Za-z0-9_-]*')) AS n_words, CASE WHEN own = '' THEN 0 ELSE len(string_split(own, chr(10))) END AS n_lines, s AS sentiment_score, CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment,
CASE WHEN {_ANY(classify.URGENT)} THEN 'urgent' WHEN {_ANY(classify.HIGH)} THEN 'high' WHEN {_ANY(classify.LOW)} THEN 'low' ELSE 'medium' END AS priority
FROM (SELECT *, round((p - n) / greatest(1, p + n)::DOUBLE, 2) AS s FROM (SELECT *, {_COUNT(classify.word_pattern(classify.POSITIVE))} AS p, {_COUNT(classify.word_pattern(classify.NEGATIVE))} AS n FROM (SELECT doc_id, lower({_PLAIN}) AS low, {_PLAIN} AS plain, {_TRIM("text")} AS own FROM documents WHERE text IS NOT NULL))))"""
_W = f"WITH {VIEWS}"
_TAGS = r"list_filter(list_transform(string_split(regexp_replace(coalesce(tags, ''), '[\[\]\"'']', '', 'g'), ','), lambda s: trim(s)), lambda s: s <> '')"
_PREVIEW = _TRIM(r"regexp_replace(substr(coalesce(raw_content, ''), 1, 240), '[ \t\n\r\f\v]+', ' ', 'g')") + " || CASE WHEN length(coalesce(raw_content, '')) > 240 THEN '...' ELSE '' END"
_FIELD = lambda name, value: f"CASE WHEN {value} IS NOT NULL THEN '\"{name}\":' || to_json({value})::VARCHAR END"
_OBJECT = lambda **fields: "'{' || concat_ws(',', " + ", ".join(_FIELD(k, v) for k, v in fields.items()) + ") || '}'"
ORACLE = {
    "export_jsonld": f"{_W} SELECT id, {_OBJECT(**{'@id': f"('{reports.RESOURCE}' || id)", 'name': 'name', 'type': 'type', 'description': 'description'})} AS json FROM node_l",
    "export_elements": f"{_W} SELECT 'node' AS kind, id, '{{\"data\":' || {_OBJECT(id='id', label='name', type='type', degree='coalesce(degree, 0)')} || coalesce(',\"position\":{{\"x\":' || to_json(layout_x)::VARCHAR || ',\"y\":' || to_json(layout_y)::VARCHAR || '}}', '') || '}}' AS json FROM node_l UNION ALL SELECT 'edge', id, '{{\"data\":' || {_OBJECT(id='id', source='source', target='target', label='predicate', weight='weight')} || '}}' FROM edge_v",
    "classify_topics": f"WITH {_topics_sql()} SELECT * FROM tp",
    "classify_tone": f"WITH {_TONE} SELECT * FROM tn",
    "auto_tags": f"WITH {_topics_sql()}, {_TONE}, ch AS (SELECT id, replace(lower(topic), ' ', '_') AS tag, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS r, percent, list_slice(list_filter(string_split(matched, ', '), lambda w: w <> ''), 1, 2) AS ws FROM tp), al AS (SELECT id, r AS k, 0 AS j, tag FROM ch WHERE r = 1 OR (r <= 3 AND percent >= 15) UNION ALL SELECT id, 10, 0, 'sentiment_' || sentiment FROM tn UNION ALL SELECT id, 11, 0, 'prio_' || priority FROM tn UNION ALL SELECT id, 20 + r, unnest(range(len(ws))), replace(lower(unnest(ws)), ' ', '_') FROM ch), un AS (SELECT id, tag, min((k, j)) AS o FROM al GROUP BY id, tag) SELECT id, string_agg(tag, ' ' ORDER BY o) AS tags FROM (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) <= 8) GROUP BY id",
    "prominent_terms": rf"WITH x AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all({_PLAIN}, '\b[A-Z][a-zA-Z0-9_-]{{2,}}\b', 0) AS l FROM documents)), c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM x GROUP BY doc_id, term), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c) SELECT doc_id AS id, term, n, rank, term AS search_key FROM r WHERE rank <= 5 AND lower(term) NOT IN ('the', 'this', 'that', 'page', 'table')",
    "note_listing": f"{_W}, c AS (SELECT note, count(DISTINCT id) AS n_entities FROM (SELECT id, regexp_replace(chunk, '_chunk_[^_]*$', '') AS note FROM node_p) GROUP BY note) SELECT id, title, len(list_filter(string_split_regex(coalesce(raw_content, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n_words, length(coalesce(raw_content, '')) AS n_chars, {_PREVIEW} AS preview, len({_TAGS}) AS n_tags, coalesce(n_entities, 0) AS n_entities FROM note_l LEFT JOIN c ON c.note = lower(trim(note_l.id)) WHERE deleted_at IS NULL",
    "gallery_search": f"{_W} SELECT id FROM note_l WHERE deleted_at IS NULL AND (contains(lower(coalesce(title, '')), 'pipeline') OR contains(lower({_PREVIEW}), 'pipeline') OR len(list_filter({_TAGS}, lambda x: contains(lower(x), 'pipeline'))) > 0)",
    "content_keys": f"{_W} SELECT substr(sha256(raw_content), 1, 16) AS content_key, count(*) AS n, min(id) AS first_id FROM note_l WHERE raw_content IS NOT NULL GROUP BY 1",
    "conversation_window": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b, least(12, count(*) OVER (PARTITION BY user_id)) AS c FROM events) SELECT user_id, event_id, event_type, c - b + 1 AS place FROM r WHERE b <= 12",
    "history_prompt": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT user_id, count(*) AS n, string_agg(concat_ws(': ', upper(event_type[1]) || lower(event_type[2:]), props), chr(10) ORDER BY b DESC) AS history FROM r WHERE b <= 6 GROUP BY user_id",
    "export_turtle": f"{_W} SELECT 'r:' || replace(lower(trim(id)), ' ', '_') || ' a r:' || replace(upper(trim(type)), ' ', '_') || ' ; rdfs:label \"' || replace(replace(name, '\\', '\\\\'), '\"', '\\\"') || '\" .' AS line FROM node_l WHERE name IS NOT NULL AND type IS NOT NULL UNION ALL SELECT 'r:' || replace(source, ' ', '_') || ' p:' || replace(lower(predicate), ' ', '_') || ' r:' || replace(target, ' ', '_') || ' .' FROM edge_v WHERE source IS NOT NULL AND target IS NOT NULL",
    "export_csv": f"{_W} SELECT 'node' AS record_type, id, name AS source_or_name, type AS target_or_type, coalesce(description, '') AS relation_or_desc, 1.0::DOUBLE AS weight FROM node_l UNION ALL SELECT 'edge', id, source, target, predicate, weight FROM edge_v",
    "export_digest": f"{_W} SELECT 1 AS section, id AS key, '- **' || name || '** (`' || type || '`): ' || coalesce(description, 'No description') AS line FROM node_l WHERE name IS NOT NULL AND type IS NOT NULL UNION ALL SELECT 2, id, '- ' || source || ' --[' || predicate || ']--> ' || target FROM edge_v WHERE source IS NOT NULL AND target IS NOT NULL AND predicate IS NOT NULL UNION ALL SELECT 3, id::VARCHAR, '### ' || coalesce(name, 'Community ' || id) || ' (Level ' || level || ')' || coalesce(chr(10) || summary, '') FROM communities",
    "export_notes": f"{_W} SELECT id || '.md' AS filename, coalesce(raw_content, '') AS content, octet_length(encode(coalesce(raw_content, ''))) AS size_bytes FROM note_l WHERE deleted_at IS NULL",
    "vector_metadata": "SELECT max(len(embedding)) AS dimension, count(embedding) AS n_vectors, count(DISTINCT vec_id) AS n_ids FROM embeddings",
    "layout_nearest": f"{_W}, p AS (SELECT id, layout_x AS x, layout_y AS y FROM node_l WHERE layout_x IS NOT NULL AND layout_y IS NOT NULL), m AS (SELECT q.id AS query_id, p.id, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 4) AS distance FROM p, p q WHERE try_cast(q.id[2:] AS BIGINT) % 50 = 0 AND p.id <> q.id AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 40) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) = 1",
    "normalize_layout": f"{_W}, p AS (SELECT id, layout_x, layout_y FROM node_l WHERE layout_x IS NOT NULL AND layout_y IS NOT NULL), b AS (SELECT min(layout_x) AS ax, max(layout_x) AS bx, min(layout_y) AS ay, max(layout_y) AS by_, greatest(max(layout_x) - min(layout_x), max(layout_y) - min(layout_y)) / 2 AS s FROM p) SELECT id, round(CASE WHEN s > 0 THEN (layout_x - (ax + bx) / 2) / s * 1000 ELSE 0 END, 2) AS x, round(CASE WHEN s > 0 THEN (layout_y - (ay + by_) / 2) / s * 1000 ELSE 0 END, 2) AS y FROM p, b",
    "layout_neighbours": f"{_W}, p AS (SELECT id, layout_x AS x, layout_y AS y FROM node_l WHERE layout_x IS NOT NULL AND layout_y IS NOT NULL) SELECT q.id AS query_id, p.id, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 4) AS distance FROM p, p q WHERE try_cast(q.id[2:] AS BIGINT) % 50 = 0 AND p.id <> q.id AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 40",
    "node_style": f"{_W} SELECT id, round(3 + least(5.0::DOUBLE, ln(coalesce(degree, 0) + 1.0::DOUBLE)), 4) AS radius, coalesce(community_id % 12, length(name) % 12) AS shade FROM node_l",
    "edge_rest_lengths": f"{_W}, dg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edge_v UNION ALL SELECT target FROM edge_v) WHERE node IS NOT NULL GROUP BY node) SELECT v.id, round(85 / sqrt(least(a.degree, b.degree) + 1.0::DOUBLE), 4) AS length FROM edge_v v JOIN dg a ON a.node = v.source JOIN dg b ON b.node = v.target WHERE v.source <> v.target",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
}
