"""Queries on retrieval, communities and note links, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import communities, lexical, links, retrieval, vault
from quillgraph.operators.references import key
from quillgraph.plans.text_queries import _POST
from quillgraph.plans.vault_queries import VIEWS
from quillgraph.session import cut
from quillgraph.sources.tables import table as t


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest(t(spark, d, "nodes"), "name", "type", "degree", "community_id", "provenance", "ingested_at")


def _view(spark: SparkSession, d: str) -> DataFrame:
    return vault.edge_view(t(spark, d, "edges"))


def _notes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Notes that are not removed: their latest rows' ids and the named columns."""
    pick = vault.latest_texts if "raw_content" in columns else vault.latest
    return pick(t(spark, d, "notes"), *columns, "deleted_at", "ingested_at").where("deleted_at IS NULL")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    pick = vault.latest_texts if "text" in columns else vault.latest
    return pick(t(spark, d, "chunks"), *columns, "ingested_at")


def route_queries(spark: SparkSession, d: str) -> DataFrame:
    """The mode of every document's title, read as a question."""
    return t(spark, d, "documents").where("title IS NOT NULL").select("doc_id", retrieval.mode("title").alias("mode"))


def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("title IS NOT NULL").select("doc_id", F.explode(retrieval.keyword_grams("title")).alias("gram"))


def bridges(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bridge_edges(_view(spark, d), _nodes(spark, d)).select("id", "c_source", "c_target")


QUESTION, HIGH, LOW = "How does the Vector Index relate to graph query and community detection in a hybrid search?", ["vector", "graph"], ["chunking", "hybrid"]


def question_entities(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that a question means."""
    nodes = vault.latest(t(spark, d, "nodes"), "name", "type", "description", "degree", "ingested_at")
    return retrieval.named_nodes(nodes, LOW, QUESTION, 25)


def community_rank(spark: SparkSession, d: str) -> DataFrame:
    best = retrieval.best_communities(retrieval.community_scores(t(spark, d, "communities"), HIGH, LOW, QUESTION), 5)
    return best.select("id", F.round("score", 6).alias("score"), "rank")


def chunk_graph_score(spark: SparkSession, d: str) -> DataFrame:
    nodes, view, comm = t(spark, d, "nodes"), _view(spark, d), t(spark, d, "communities")
    matched = cut(question_entities(spark, d), "matched")
    near = view.join(vault.incident_edges(view, matched.select(key("id").alias("node"))).select("id"), "id", "left_semi")
    best = community_rank(spark, d)
    scores = retrieval.chunk_scores(matched, near, retrieval.top_members(comm, best), retrieval.bridge_edges(view, _nodes(spark, d)), nodes)
    return scores.select("chunk", F.round("score", 6).alias("score"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_chunks(spark, d, "text"), ["graph", "vector"], every=False).select(key("chunk_id").alias("chunk"), F.round("score", 6).alias("score"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks by three lists: dense, lexical and graph."""
    lists = [(dense_search(spark, d), 0.5), (_bm25(spark, d), 0.5), (chunk_graph_score(spark, d), 0.5)]
    return retrieval.reciprocal_rank_fusion(lists, 50).select("chunk", F.round("score", 6).alias("score"))


def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """The chunks whose vectors are nearest to the question's."""
    return retrieval.dense_list(_chunks(spark, d, "text"), QUESTION, 500).select("chunk", F.round("score", 6).alias("score"))


def search_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The search with all lists against the one without the graph."""
    full = cut(rrf_fusion(spark, d), "fused")
    return retrieval.agreement(full, retrieval.reciprocal_rank_fusion([(dense_search(spark, d), 0.5), (_bm25(spark, d), 0.5)], 50))


def local_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of chunks and of the first entities."""
    chunks = _cited(spark, d).select(F.lit("chunk").alias("source_type"), F.col("chunk").alias("id"), "title", "snippet", "score")
    return chunks.unionByName(retrieval.entity_citations(question_entities(spark, d)).select(F.lit("node").alias("source_type"), "id", "title", "snippet", "score"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.citations(rrf_fusion(spark, d), _chunks(spark, d, "note_id", "text"), vault.latest(t(spark, d, "notes"), "title", "ingested_at"))


def question_relations(spark: SparkSession, d: str) -> DataFrame:
    """The first relations of the nodes that a question means."""
    view = _view(spark, d)
    return vault.incident_edges(view, question_entities(spark, d).select(key("id").alias("node"))).select("id", "source", "predicate", "target").orderBy("id").limit(15)


def local_search(spark: SparkSession, d: str) -> DataFrame:
    """What a question about single things finds: the context of an answer, and how much each channel gave."""
    matched, comm = cut(question_entities(spark, d), "matched"), t(spark, d, "communities")
    relations, cited = cut(question_relations(spark, d), "relations"), cut(_cited(spark, d), "cited")
    best = cut(community_rank(spark, d).join(comm.select("id", "name", "summary"), "id").select("rank", "name", "summary"), "best")
    context = retrieval.context_block(matched, relations, best, cited)
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((matched, "n_entities"), (relations, "n_relations"), (best, "n_communities"), (cited, "n_chunks"))]
    for c in counts:
        context = context.crossJoin(F.broadcast(c))  # one row each
    return context.withColumn("confidence", F.lit(0.92))


def global_insights(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.global_insights(t(spark, d, "communities"))


def community_internal_edges(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.internal_edges(_view(spark, d), t(spark, d, "communities"))


def community_summary(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.community_summaries(t(spark, d, "communities"), _nodes(spark, d), community_internal_edges(spark, d))


def community_writeback(spark: SparkSession, d: str) -> DataFrame:
    """Communities with their new summaries written over the stored ones."""
    made = communities.with_summaries(t(spark, d, "communities"), community_summary(spark, d))
    return made.select("id", "name", "summary", "themes", "confidence")


def leading_themes(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.leading_themes(t(spark, d, "communities"))


def rag_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Titles as questions, first sentences of notes as answers, the notes' chunks as contexts."""
    notes = _notes(spark, d, "title", "raw_content").select(key("id").alias("id"), F.col("title").alias("question"), F.substring_index("raw_content", ".", 1).alias("answer"))
    contexts = _chunks(spark, d, "note_id", "text").where("text IS NOT NULL").select(key("note_id").alias("id"), F.col("text").alias("context"))
    return retrieval.answer_scores(notes, contexts)


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Notes of every entity: those its chunks come from, and those that mention its name."""
    own = links.entity_notes(vault.provenance(t(spark, d, "nodes")), _chunks(spark, d, "note_id"), _notes(spark, d))
    return own.unionByName(entity_mentions(spark, d)).distinct()


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return links.mentions(vault.latest(t(spark, d, "nodes"), "name", "ingested_at"), _notes(spark, d, "title", "raw_content"))


def explicit_links(spark: SparkSession, d: str) -> DataFrame:
    return links.explicit_links(_notes(spark, d, "title", "source_file", "raw_content"))


def stored_note_links(spark: SparkSession, d: str) -> DataFrame:
    return links.stored_links(_view(spark, d), _notes(spark, d))


def shared_entity_classes(spark: SparkSession, d: str) -> DataFrame:
    return links.shared_entity_classes(_held(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d, "title", "raw_content").select(key("id").alias("id"), F.concat_ws(" ", "title", "raw_content").alias("text"))


def similar_notes(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of notes whose texts are similar."""
    return links.similar_texts(_texts(spark, d), "id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


def shared_entity_links(spark: SparkSession, d: str) -> DataFrame:
    return links.shared_entity_links(cut(_held(spark, d), "held"))


def relation_bridge_links(spark: SparkSession, d: str) -> DataFrame:
    return links.relation_links(_view(spark, d), cut(_held(spark, d), "held"))


def _first_stages(spark: SparkSession, d: str) -> list[DataFrame]:
    """Links of all stages but the last one."""
    held, view = cut(_held(spark, d), "held"), cut(_view(spark, d), "view")
    return [explicit_links(spark, d), links.stored_links(view, _notes(spark, d)), links.shared_entity_links(held), links.relation_links(view, held)]


def auto_link_graph(spark: SparkSession, d: str) -> DataFrame:
    return links.note_graph(*_first_stages(spark, d), similar_notes(spark, d))


def _linked_counts(spark: SparkSession, d: str) -> DataFrame:
    """``(note, n)`` of the notes with links of any stage, without a row for each link by similarity."""
    return links.linked_counts(_texts(spark, d), "id", "text", links.link_pairs(*_first_stages(spark, d)))


def note_degrees(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d, "title")
    return links.linked_notes(notes, links.with_degrees(notes, _linked_counts(spark, d)))


def note_communities(spark: SparkSession, d: str) -> DataFrame:
    """Community of every note by the links of all stages; a note without links is one of its own."""
    graph = auto_link_graph(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w"))
    found = communities.detect(cut(graph, "note-graph"))
    return _notes(spark, d).select(key("id").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def note_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return links.graph_stats(_notes(spark, d), _linked_counts(spark, d))


QUERIES = {f.__name__: f for f in (route_queries, query_keywords, bridges, question_entities, question_relations, community_rank, chunk_graph_score, dense_search, rrf_fusion, search_ablation, local_citations, local_search, global_insights, community_internal_edges, community_summary, community_writeback, leading_themes, rag_metrics, explicit_links, stored_note_links, entity_mentions, shared_entity_classes, shared_entity_links, relation_bridge_links, similar_notes, auto_link_graph, note_graph_stats, note_degrees, note_communities)}

_PLAIN = r"regexp_replace(regexp_replace(title, '[^\x00-\x7F\p{L}\p{N}]', '-', 'g'), '[^\x00-\x7F]', '_', 'g')"
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_SCORES = rf"""
bridge AS (SELECT v.id, a.community_id AS c_source, b.community_id AS c_target FROM edge_v v JOIN node_l a ON lower(trim(a.id)) = v.source JOIN node_l b ON lower(trim(b.id)) = v.target WHERE a.community_id <> b.community_id),
qt AS (SELECT term, count(*)::DOUBLE AS tf FROM (SELECT unnest(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9]+')) AS term) GROUP BY term),
sv AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(list_filter(string_split_regex(lower(coalesce(summary, '')), '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '')) AS term FROM communities) GROUP BY id, term),
sc AS (SELECT s.id, sum(s.tf * coalesce(qt.tf, 0)) / sqrt(sum(s.tf * s.tf)) / (SELECT sqrt(sum(tf * tf)) FROM qt) AS cos FROM sv s LEFT JOIN qt USING (term) GROUP BY s.id),
cs AS (SELECT id, 2.0::DOUBLE * contains(x, 'vector')::INT + 2.0::DOUBLE * contains(x, 'graph')::INT + 0.5::DOUBLE * contains(x, 'chunking')::INT + 0.5::DOUBLE * contains(x, 'hybrid')::INT + 3 * coalesce((SELECT cos FROM sc WHERE sc.id = c.id), 0) AS score FROM (SELECT id, lower(concat_ws(' ', coalesce(name, ''), coalesce(summary, ''), coalesce(array_to_string(from_json(themes, '["VARCHAR"]'), ' '), ''))) AS x FROM communities) c),
best AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 5 AND (score > 0 OR max(score) OVER () <= 0)),
kw AS (SELECT unnest(['chunking', 'hybrid']) AS w, unnest([0, 1]) AS turn),
nl AS (SELECT id, name, type, description, coalesce(degree, 0)::BIGINT AS degree FROM node_l),
h0 AS (SELECT nl.*, turn, -degree AS d FROM nl JOIN kw ON contains(lower(concat_ws(chr(10), name, description)), w) QUALIFY row_number() OVER (PARTITION BY turn ORDER BY degree DESC, id) <= 25),
h1 AS (SELECT nl.*, 2 AS turn, 0 AS d FROM nl WHERE (name <> '' AND contains(lower('{QUESTION}'), lower(name))) OR contains(lower(name), 'chunking') OR contains(lower(name), 'hybrid')),
hit AS (SELECT id, name, type, description, degree, row_number() OVER (ORDER BY turn, d, id) AS place FROM (SELECT * FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, d) = 1) QUALIFY place <= 25),
near AS (SELECT * FROM edge_v WHERE source IN (SELECT lower(trim(id)) FROM hit) OR target IN (SELECT lower(trim(id)) FROM hit)),
gs AS (SELECT chunk, round(sum(s), 6) AS score FROM (
  SELECT chunk, 1.5::DOUBLE * (1 + 0.1::DOUBLE * least(degree, 10)) AS s FROM node_p JOIN hit USING (id)
  UNION ALL SELECT chunk, weight * confidence FROM near JOIN edge_p USING (id)
  UNION ALL SELECT chunk, 0.8::DOUBLE FROM member JOIN best USING (id) JOIN node_p p ON lower(trim(p.id)) = member.node WHERE pos < 10
  UNION ALL SELECT chunk, 1.2::DOUBLE FROM bridge JOIN edge_p USING (id)) GROUP BY chunk)"""
_BM = f"""{_POST}, st AS (SELECT (SELECT count(*) FROM chunk_l) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM chunk_l)::DOUBLE AS mean), q AS (SELECT term, count(*) AS df FROM post WHERE term IN ('graph', 'vector') GROUP BY term),
w AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf, mean FROM q, st),
bm AS (SELECT lower(trim(chunk_id)) AS chunk, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM post JOIN w USING (term) GROUP BY chunk_id)"""
_DENSE = "dn AS (SELECT chunk, round(s, 6) AS score FROM (SELECT lower(trim(chunk_id)) AS chunk, round(sum(post.tf * coalesce(qt.tf, 0)) / sqrt(sum(post.tf::DOUBLE * post.tf)) / (SELECT sqrt(sum(tf * tf)) FROM qt), 9) AS s FROM post LEFT JOIN qt USING (term) GROUP BY chunk_id) WHERE s > 0 ORDER BY s DESC, chunk LIMIT 500)"
_RRF = _DENSE + ", rrf AS (SELECT chunk, round(sum(s), 6) AS score, sum(s) AS exact FROM (SELECT chunk, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk)) AS s FROM dn UNION ALL SELECT chunk, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk)) AS s FROM bm QUALIFY row_number() OVER (ORDER BY score DESC, chunk) <= 500 UNION ALL SELECT chunk, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk)) FROM gs QUALIFY row_number() OVER (ORDER BY score DESC, chunk) <= 500) GROUP BY chunk ORDER BY round(sum(s), 9) DESC, chunk LIMIT 50)"
_STEM = lambda c: rf"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({c}, '(?i)\.md$', ''), '[^\p{{L}}\p{{N}}_ \t\n\r\f\v-]', '', 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), '[ \t\n\r\f\v-]+', '_', 'g')"
_MARKED = lambda c: rf"regexp_replace(lower({c}), '[\p{{L}}\p{{N}}_]+', chr(1) || '\0' || chr(1), 'g')"
_LINKS = rf"""
live AS (SELECT * FROM note_l WHERE deleted_at IS NULL),
al AS (SELECT alias, max(note) AS note FROM (SELECT id AS note, unnest([lower(id), {_STEM("id")}, lower(title), {_STEM("title")}, lower(f), lower(regexp_replace(f, '\.[^.]*$', '')), {_STEM("f")}]) AS alias FROM (SELECT *, regexp_extract(source_file, '([^/]*)$', 1) AS f FROM live)) WHERE alias <> '' GROUP BY alias),
tg AS (SELECT DISTINCT a, lower(m) AS exact, {_STEM("m")} AS clean FROM (SELECT id AS a, trim(unnest(regexp_extract_all(raw_content, '\[\[([^\]\|#]+)(?:#[^\]\|]+)?(?:\|[^\]]+)?\]\]', 1))) AS m FROM live)),
ex AS (SELECT DISTINCT a, coalesce(x.note, y.note) AS b FROM tg LEFT JOIN al x ON x.alias = exact LEFT JOIN al y ON y.alias = clean WHERE coalesce(x.note, y.note) <> a),
men AS (SELECT DISTINCT lower(trim(n.id)) AS entity, lower(trim(l.id)) AS note FROM (SELECT id, {_MARKED("trim(name)")} AS m FROM node_l WHERE length(trim(name)) >= 4 AND NOT starts_with(lower(trim(name)), 'untitled')) n JOIN (SELECT id, {_MARKED("coalesce(title, '') || ' ' || coalesce(raw_content, '')")} AS x FROM live) l ON contains(l.x, n.m)),
held AS (SELECT DISTINCT lower(trim(p.id)) AS entity, coalesce(nullif(lower(trim(c.note_id)), ''), regexp_replace(p.chunk, '_chunk_[^_]*$', '')) AS note FROM node_p p LEFT JOIN chunk_l c ON lower(trim(c.id)) = p.chunk WHERE coalesce(nullif(lower(trim(c.note_id)), ''), regexp_replace(p.chunk, '_chunk_[^_]*$', '')) IN (SELECT lower(trim(id)) FROM live) UNION SELECT entity, note FROM men),
sl AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(weight) AS weight FROM edge_v WHERE source <> target AND source IN (SELECT lower(trim(id)) FROM live) AND target IN (SELECT lower(trim(id)) FROM live) GROUP BY 1, 2),
sh AS (SELECT x.note AS a, y.note AS b, count(*) AS n_shared FROM held x JOIN held y USING (entity) WHERE x.note < y.note GROUP BY a, b),
rl AS (SELECT least(x.note, y.note) AS a, greatest(x.note, y.note) AS b, round(max(CASE WHEN weighted THEN weight ELSE 0.8::DOUBLE END), 2) AS weight FROM edge_v JOIN held x ON x.entity = source JOIN held y ON y.entity = target WHERE source <> target AND x.note <> y.note GROUP BY 1, 2),
tv AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, tf * ln((SELECT count(DISTINCT id) FROM live) / df::DOUBLE) AS w FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT id, term, count(*) AS tf FROM (SELECT lower(trim(id)) AS id, unnest(list_filter(string_split_regex(lower(concat_ws(' ', title, raw_content)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM live) GROUP BY id, term))) WHERE w > 0),
sm AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS s FROM tv x JOIN tv y USING (term) WHERE x.id < y.id GROUP BY x.id, y.id HAVING s >= 0.70::DOUBLE),
ng AS (SELECT a, b, min(stage)::BIGINT AS stage, arg_min(weight, (stage, -weight)) AS weight FROM (SELECT least(lower(trim(a)), lower(trim(b))) AS a, greatest(lower(trim(a)), lower(trim(b))) AS b, 1 AS stage, 1.0::DOUBLE AS weight FROM ex UNION ALL SELECT a, b, 2, weight FROM sl UNION ALL SELECT a, b, 3, 0.85::DOUBLE FROM sh UNION ALL SELECT a, b, 4, weight FROM rl UNION ALL SELECT a, b, 5, round(s, 3) FROM sm) GROUP BY a, b)"""
_TOKS = lambda c: rf"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '[ \t\n\r\f\v]+'), lambda z: z <> ''))"
_IN = "ie AS (SELECT DISTINCT a.id AS community, v.id, v.source, v.predicate, v.target FROM edge_v v JOIN member a ON a.node = v.source JOIN member b ON b.node = v.target AND b.id = a.id)"
_W = f"WITH {VIEWS}"
ORACLE = {
    "route_queries": rf"SELECT doc_id, CASE WHEN regexp_matches(lower({_PLAIN}), '\b(?:{'|'.join(retrieval.GLOBAL_PHRASES)})\b') OR regexp_matches(lower({_PLAIN}), '{retrieval.GLOBAL_PAIR}') THEN 'global' ELSE 'local' END AS mode FROM documents WHERE title IS NOT NULL",
    "query_keywords": rf"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all({_PLAIN}, '[a-zA-Z0-9_-]+', 0), lambda x: lower(x) NOT IN ({_STOP})) AS w FROM documents WHERE title IS NOT NULL) SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(list_concat(list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')), list_transform(range(1, len(w)), lambda i: array_to_string(list_slice(w, i, i + 1), ' '))), w)) AS gram FROM w)",
    "bridges": f"{_W}, {_SCORES} SELECT * FROM bridge",
    "question_entities": f"{_W}, {_SCORES} SELECT * FROM hit",
    "question_relations": f"{_W}, {_SCORES} SELECT id, source, predicate, target FROM near ORDER BY id LIMIT 15",
    "dense_search": f"{_W}, {_SCORES}, {_BM}, {_DENSE} SELECT * FROM dn",
    "search_ablation": f"{_W}, {_SCORES}, {_BM}, {_RRF}, two AS (SELECT chunk, sum(s) AS e FROM (SELECT chunk, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk)) AS s FROM dn UNION ALL SELECT chunk, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk)) FROM bm QUALIFY row_number() OVER (ORDER BY score DESC, chunk) <= 500) GROUP BY chunk ORDER BY round(e, 9) DESC, chunk LIMIT 50), j AS (SELECT count(rrf.chunk) AS n_one, count(two.chunk) AS n_two, count(*) FILTER (WHERE rrf.chunk IS NOT NULL AND two.chunk IS NOT NULL) AS overlap, count(*) AS n FROM rrf FULL JOIN two USING (chunk)) SELECT n_one, n_two, overlap, round(overlap / n::DOUBLE, 3) AS jaccard FROM j",
    "community_rank": f"{_W}, {_SCORES} SELECT id, round(score, 6) AS score, rank FROM best",
    "chunk_graph_score": f"{_W}, {_SCORES} SELECT * FROM gs",
    "rrf_fusion": f"{_W}, {_SCORES}, {_BM}, {_RRF} SELECT chunk, score FROM rrf",
    "local_citations": f"{_W}, {_SCORES}, {_BM}, {_RRF} SELECT 'node' AS source_type, id, name AS title, coalesce(description, 'Entity: ' || name || ' (' || type || ')') AS snippet, 1.0::DOUBLE AS score FROM hit WHERE place <= 3 UNION ALL SELECT 'chunk', r.chunk, coalesce(n.title, r.chunk) AS title, substr(c.text, 1, 300) AS snippet, r.score FROM rrf r JOIN chunk_l c ON lower(trim(c.id)) = r.chunk LEFT JOIN note_l n ON lower(trim(n.id)) = lower(trim(c.note_id))",
    "global_insights": "SELECT id, name || ': ' || substr(summary, 1, 250) AS insight, coalesce(confidence, 1.0::DOUBLE) AS score FROM communities WHERE summary IS NOT NULL AND (level = 0 OR (SELECT min(level) FROM communities WHERE summary IS NOT NULL) > 0)",
    "community_internal_edges": f"{_W}, {_IN} SELECT * FROM ie",
    "community_summary": f"{_W}, {_IN}, m AS (SELECT member.id AS community, count(*) AS n_members, array_to_string(list_slice(list(n.name ORDER BY pos), 1, 5), ', ') AS themes FROM member JOIN node_l n ON lower(trim(n.id)) = member.node GROUP BY member.id), e AS (SELECT community, count(*) AS n_edges, array_to_string(list_slice(list(concat_ws(' ', source, lower(predicate), target) ORDER BY id), 1, 5), '; ') AS said FROM ie GROUP BY community) SELECT community, n_members, coalesce(n_edges, 0) AS n_edges, themes, 'Thematic cluster focusing on ' || themes || '. Key relationships include: ' || coalesce(said, 'interconnected conceptual relationships') || '.' AS summary FROM m LEFT JOIN e USING (community)",
    "community_writeback": f"{_W}, {_IN}, m AS (SELECT member.id AS community, count(*) AS n_members, array_to_string(list_slice(list(n.name ORDER BY pos), 1, 5), ', ') AS themes FROM member JOIN node_l n ON lower(trim(n.id)) = member.node GROUP BY member.id), e AS (SELECT community, count(*) AS n_edges, array_to_string(list_slice(list(concat_ws(' ', source, lower(predicate), target) ORDER BY id), 1, 5), '; ') AS said FROM ie GROUP BY community), cm AS (SELECT community, n_members, coalesce(n_edges, 0) AS n_edges, themes, 'Thematic cluster focusing on ' || themes || '. Key relationships include: ' || coalesce(said, 'interconnected conceptual relationships') || '.' AS summary FROM m LEFT JOIN e USING (community)) SELECT c.id, c.name, coalesce(cm.summary, c.summary) AS summary, coalesce(cm.themes, c.themes) AS themes, c.confidence FROM communities c LEFT JOIN cm ON cm.community = c.id",
    "leading_themes": "SELECT theme, count(*) AS n, arg_min(id, (id, pos)) AS first_id FROM (SELECT id, unnest(l) AS theme, unnest(range(len(l))) AS pos FROM (SELECT id, from_json(themes, '[\"VARCHAR\"]') AS l FROM communities)) GROUP BY theme ORDER BY min((id, pos)), theme LIMIT 8",
    "rag_metrics": f"{_W}, {_LINKS}, n AS (SELECT lower(trim(id)) AS id, {_TOKS('title')} AS q, {_TOKS('''split_part(raw_content, '.', 1)''')} AS a, coalesce((SELECT list(text) FROM chunk_l c WHERE lower(trim(c.note_id)) = lower(trim(live.id)) AND text IS NOT NULL), []) AS c FROM live), s AS (SELECT id, len(list_filter(c, lambda t: list_has_any({_TOKS('t')}, q))) / greatest(len(c), 1)::DOUBLE AS p, least(1.0::DOUBLE, len(list_intersect(a, {_TOKS('''array_to_string(c, ' ')''')})) / greatest(1.0::DOUBLE, len(a) * 0.7::DOUBLE)) AS f, least(1.0::DOUBLE, len(list_intersect(q, a)) / greatest(1.0::DOUBLE, len(q) * 0.5::DOUBLE)) AS r FROM n) SELECT id, round(p, 3) AS context_precision, round(f, 3) AS faithfulness, round(r, 3) AS answer_relevance, round(p * 0.3::DOUBLE + f * 0.4::DOUBLE + r * 0.3::DOUBLE, 3) AS overall FROM s",
    "explicit_links": f"{_W}, {_LINKS} SELECT * FROM ex",
    "stored_note_links": f"{_W}, {_LINKS} SELECT * FROM sl",
    "entity_mentions": f"{_W}, {_LINKS} SELECT * FROM men",
    "shared_entity_classes": f"{_W}, {_LINKS}, s AS (SELECT note, string_agg(entity, '|' ORDER BY entity) AS es, count(*) AS n_entities FROM held GROUP BY note) SELECT note, min(note) OVER (PARTITION BY es) AS class, n_entities, count(*) OVER (PARTITION BY es) AS n_notes FROM s",
    "similar_notes": f"{_W}, {_LINKS} SELECT a, b, round(s, 6) AS similarity FROM sm",
    "note_degrees": f"{_W}, {_LINKS} SELECT id, title, coalesce(n, 0) AS degree FROM live LEFT JOIN (SELECT note, count(*) AS n FROM (SELECT a AS note FROM ng UNION ALL SELECT b FROM ng) GROUP BY note) k ON k.note = lower(trim(live.id))",
    "shared_entity_links": f"{_W}, {_LINKS} SELECT * FROM sh",
    "relation_bridge_links": f"{_W}, {_LINKS} SELECT * FROM rl",
    "auto_link_graph": f"{_W}, {_LINKS} SELECT * FROM ng",
    "note_graph_stats": f"{_W}, {_LINKS} SELECT n AS notes, m AS links, round(CASE WHEN n > 1 THEN 2 * m / (n * (n - 1))::DOUBLE ELSE 0 END, 6) AS density, round(CASE WHEN n > 0 THEN 2 * m / n::DOUBLE ELSE 0 END, 4) AS avg_degree FROM (SELECT (SELECT count(*) FROM live) AS n, (SELECT count(*) FROM ng) AS m)",
}
