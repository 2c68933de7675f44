"""Queries on texts, extraction, lexical and vector search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as x
from quillgraph.operators import chunking, embeddings, extraction, lexical, vault, vectors
from quillgraph.plans.vault_queries import VIEWS
from quillgraph.session import cut
from quillgraph.sources.tables import table as t


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest_texts(t(spark, d, "notes"), "raw_content", "ingested_at")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest_texts(t(spark, d, "chunks"), "text", "ingested_at")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(x.sentences("text")).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", x.token_estimate("text").alias("n_tokens"))


def note_stats(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).where("raw_content IS NOT NULL").select("id", F.size(x.words("raw_content")).cast("bigint").alias("n_words"), F.length("raw_content").cast("bigint").alias("n_chars"), x.preview("raw_content").alias("preview"))


def chunk_notes(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_notes(_notes(spark, d).select("id", x.body("raw_content").alias("raw_content")))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").where(F.col("text").rlike(r"(?s)^---\s*\n.*?\n---\s*\n")).select("doc_id", "text", x.front_matter("text").alias("m"))
    return rows.select("doc_id", F.regexp_replace(F.coalesce(F.try_element_at("m", F.lit("title")), x.first_heading(x.body("text"))), '"', "").alias("title"), F.array_join(x.tag_list(F.try_element_at("m", F.lit("tags"))), "|").alias("tags"))


def first_headings(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", x.first_heading("text").alias("heading")).where("heading IS NOT NULL")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest(t(spark, d, "notes"), "title", "source_file", "ingested_at").where("title IS NOT NULL").select("id", x.slug("title").alias("slug"), x.clean_stem("source_file").alias("stem"))


def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.posexplode(x.wikilinks("text")).alias("pos", "target")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "target")


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extraction.chunk_entities(_chunks(spark, d))


def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    return extraction.chunk_relations(extraction.chunk_entities(_chunks(spark, d)))


def entity_merge_exact(spark: SparkSession, d: str) -> DataFrame:
    return extraction.merged_entities(extraction.chunk_entities(_chunks(spark, d)))


def relation_distinct(spark: SparkSession, d: str) -> DataFrame:
    return extraction.distinct_relations(vault.edge_view(t(spark, d, "edges")), "source", "predicate", "target", ["ingested_at", "id"])


def canonical_relations(spark: SparkSession, d: str) -> DataFrame:
    entities = cut(extraction.chunk_entities(_chunks(spark, d)), "entities")
    relations = extraction.chunk_relations(entities).withColumn("predicate", F.lit("relates_to"))
    return extraction.canonical_relations(entities, relations)


def node_merge(spark: SparkSession, d: str) -> DataFrame:
    return extraction.merged_nodes(vault.latest(t(spark, d, "nodes"), "name", "type", "description", "degree", "ingested_at"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(_chunks(spark, d))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(lexical.postings(_chunks(spark, d)))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.bm25(_chunks(spark, d), ["graph", "vector", "query"], every=True)
    return found.select("chunk_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(50)


def fts_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of notes that are not removed, by stems."""
    found = lexical.bm25(_chunks(spark, d), ["graphs", "queries"], every=True, stemmed=True)
    gone = vault.deleted_chunks(t(spark, d, "chunks"), t(spark, d, "notes"))
    shown = found.withColumn("chunk", F.lower(F.trim("chunk_id"))).join(gone, "chunk", "left_anti")
    return shown.select("chunk_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(50)


def community_search(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "communities").select("id", F.concat_ws(" ", "name", "summary", "themes").alias("text"))
    return lexical.bm25(rows, ["vector", "graph", "index"], every=False).select("chunk_id", F.round("score", 6).alias("score"))


def node_texts(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.node_texts(vault.latest(t(spark, d, "nodes"), "name", "description", "ingested_at"))


def note_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean word vectors of all notes, learned from the notes; words that occur twice at least."""
    tokens = cut(embeddings.tokenised(_notes(spark, d), "id", "raw_content"), "tokens")
    return embeddings.mean_vectors(tokens, embeddings.word_vectors(tokens, least=2))


def built_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.built_graph(_chunks(spark, d))[0]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    return vectors.search(e, e.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def semantic_links(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    return vectors.search(e, e.where("vec_id % 50 = 0"), 1000, least=0.25).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def vector_remove(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    return vectors.remove(e, e.where("label = 1")).select("vec_id", "label")


def mean_pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mean_pair_similarity(t(spark, d, "embeddings"), "label")


QUERIES = {f.__name__: f for f in (sentences, token_estimates, note_stats, chunk_notes, front_matter, first_headings, slugs, wikilinks, extract_entities, extract_relations, entity_merge_exact, node_merge, canonical_relations, relation_distinct, postings, doc_freq, bm25_search, fts_search, community_search, node_texts, note_vectors, built_nodes, vector_topk, semantic_links, vector_remove, mean_pairwise_cosine)}

_TRIM = lambda c: rf"regexp_replace({c}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
_UNMARK = r"regexp_replace(m, '^(\*\*|`)|(\*\*|`)$', '', 'g')"
_ENT = rf"""
src AS (SELECT id AS chunk_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F\p{{L}}\p{{N}}]', '-', 'g'), '[^\x00-\x7F]', '_', 'g') AS plain FROM chunk_l),
marks AS (SELECT chunk_id, 1 AS pass, pos, m FROM (SELECT chunk_id, unnest(l) AS m, unnest(range(len(l))) AS pos FROM (SELECT chunk_id, regexp_extract_all(text, '\*\*([^*]+)\*\*|`([^`]+)`', 0) AS l FROM src))),
caps AS (SELECT chunk_id, 2 AS pass, pos, m FROM (SELECT chunk_id, unnest(l) AS m, unnest(range(len(l))) AS pos FROM (SELECT chunk_id, regexp_extract_all(plain, '\b[A-Z][a-z0-9]+(?:[ \t\n\r\f\v]+[A-Z][a-z0-9]+)*\b', 0) AS l FROM src))),
named AS (
  SELECT chunk_id, pass, pos, {_TRIM(_UNMARK)} AS name, CASE WHEN m LIKE '`%' THEN 'TECHNOLOGY' ELSE 'CONCEPT' END AS type FROM marks
  UNION ALL SELECT chunk_id, pass, pos, m, CASE WHEN regexp_matches(m, '^[^ \t\n\r\f\v]+[ \t\n\r\f\v]+[^ \t\n\r\f\v]+$') AND NOT regexp_matches(m, '[0-9]') THEN 'PERSON' ELSE 'CONCEPT' END FROM caps WHERE length(m) > 2 AND lower(m) NOT IN ('the', 'this', 'that', 'there', 'with', 'from', 'when')),
kept AS (SELECT *, lower(name) AS k, row_number() OVER (PARTITION BY chunk_id, lower(name) ORDER BY pass, pos) AS f, row_number() OVER (PARTITION BY chunk_id, lower(name) ORDER BY pass, CASE WHEN pass = 1 THEN -pos ELSE pos END) AS l FROM named WHERE pass = 2 OR length(name) BETWEEN 3 AND 49),
ent AS (SELECT a.chunk_id, row_number() OVER (PARTITION BY a.chunk_id ORDER BY a.pass, a.pos) AS ord, b.name, b.type, CASE WHEN b.pass = 1 THEN 0.8::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM kept a JOIN kept b ON a.chunk_id = b.chunk_id AND a.k = b.k WHERE a.f = 1 AND b.l = 1)
"""
_NAME = "regexp_replace(lower(" + _TRIM(r"regexp_replace(name, '[^\p{L}\p{N}_ \t\n\r\f\v-]', '', 'g')") + r"), '[ \t\n\r\f\v]+', ' ', 'g')"
_POST = r"post AS (SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT chunk_id, len(l) AS length, unnest(l) AS term FROM (SELECT id AS chunk_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM chunk_l)) GROUP BY chunk_id, term)"
_SIMS = "sims AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)"
_FM = r"(?s)^---[ \t\n\r\f\v]*\n(.*?)\n---[ \t\n\r\f\v]*\n"
ORACLE = {
    "sentences": "SELECT doc_id, pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+([A-Z0-9#*-])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '|\\n\\n+'), lambda s: " + _TRIM("s") + "), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL))",
    "token_estimates": r"SELECT doc_id, greatest(1, floor(len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) * 13 / 10)::BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "note_stats": f"WITH {VIEWS} " + r"SELECT id, len(list_filter(string_split_regex(raw_content, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS n_words, length(raw_content) AS n_chars, " + _TRIM(r"regexp_replace(substr(raw_content, 1, 240), '[ \t\n\r\f\v]+', ' ', 'g')") + " || CASE WHEN length(raw_content) > 240 THEN '...' ELSE '' END AS preview FROM note_l WHERE raw_content IS NOT NULL",
    "front_matter": rf"WITH f AS (SELECT doc_id, regexp_extract(text, '{_FM}', 1) AS b FROM documents WHERE regexp_matches(text, '{_FM}')) SELECT doc_id, replace({_TRIM("regexp_extract(b, '(?m)^[ \\t]*title:(.*)$', 1)")}, chr(34), '') AS title, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_extract(b, '(?m)^[ \t]*tags:(.*)$', 1), '[\[\]\"'']', '', 'g'), ','), lambda s: {_TRIM('s')}), lambda s: s <> ''), '|') AS tags FROM f",
    "first_headings": r"SELECT doc_id, h AS heading FROM (SELECT doc_id, " + _TRIM(r"regexp_extract(text, '(?m)^#[ \t\n\r\f\v]+(.+)$', 1)") + " AS h FROM documents) WHERE h <> ''",
    "slugs": f"WITH {VIEWS} SELECT id, CASE WHEN s = '' THEN 'note' ELSE s END AS slug, stem FROM (SELECT id, regexp_replace(lower(" + _TRIM(r"regexp_replace(title, '[^\p{L}\p{N}_ \t\n\r\f\v-]', '', 'g')") + r"), '[ \t\n\r\f\v]+', '_', 'g') AS s, regexp_replace(lower(" + _TRIM(r"regexp_replace(regexp_replace(source_file, '(?i)\.md$', ''), '[^\p{L}\p{N}_ \t\n\r\f\v-]', '', 'g')") + r"), '[ \t\n\r\f\v-]+', '_', 'g') AS stem FROM note_l WHERE title IS NOT NULL)",
    "wikilinks": r"SELECT doc_id, pos, trim(m) AS target FROM (SELECT doc_id, unnest(l) AS m, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\[\[([^\]\|#]+)(?:#[^\]\|]+)?(?:\|[^\]]+)?\]\]', 1) AS l FROM documents))",
    "extract_entities": f"WITH {VIEWS}, {_ENT} SELECT * FROM ent",
    "extract_relations": f"WITH {VIEWS}, {_ENT} SELECT * FROM (SELECT chunk_id, ord, name AS subject, lead(name) OVER (PARTITION BY chunk_id ORDER BY ord) AS object FROM ent) WHERE object IS NOT NULL",
    "entity_merge_exact": f"WITH {VIEWS}, {_ENT}, k AS (SELECT *, {_NAME} AS key FROM ent) SELECT key, arg_min(name, (chunk_id, ord)) AS name, arg_min(type, (chunk_id, ord)) AS type, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_mentions, max(confidence) AS confidence FROM k WHERE key <> '' GROUP BY key",
    "node_merge": f"WITH {VIEWS}, k AS (SELECT *, {_NAME} AS key FROM node_l) SELECT key, arg_min(name, id) AS name, arg_min(type, id) AS type, arg_min(description, (-length(description), id)) FILTER (WHERE description IS NOT NULL) AS description, coalesce(max(degree), 0)::BIGINT AS degree, count(*) AS n FROM k WHERE key <> '' GROUP BY key",
    "canonical_relations": f"WITH {VIEWS}, {_ENT}, k AS (SELECT *, {_NAME} AS key FROM ent), m AS (SELECT key, arg_min(name, (chunk_id, ord)) AS name FROM k WHERE key <> '' GROUP BY key), r AS (SELECT chunk_id, ord, name AS sn, key AS sk, lead(name) OVER w AS xn, lead(key) OVER w AS xk FROM k WINDOW w AS (PARTITION BY chunk_id ORDER BY ord)), c AS (SELECT r.chunk_id, r.ord, coalesce(a.name, {_TRIM('sn')}) AS s, coalesce(b.name, {_TRIM('xn')}) AS o FROM r LEFT JOIN m a ON a.key = sk LEFT JOIN m b ON b.key = xk WHERE xn IS NOT NULL) SELECT arg_min(s, (chunk_id, ord)) AS subject, 'RELATES_TO' AS predicate, arg_min(o, (chunk_id, ord)) AS object, count(*) AS n FROM c WHERE lower(s) <> lower(o) GROUP BY lower(s), lower(o)",
    "built_nodes": f"WITH {VIEWS}, {_ENT}, k AS (SELECT *, {_NAME} AS key FROM ent), m AS (SELECT key, arg_min(name, (chunk_id, ord)) AS name FROM k WHERE key <> '' GROUP BY key), r AS (SELECT chunk_id, ord, name AS sn, key AS sk, lead(name) OVER w AS xn, lead(key) OVER w AS xk FROM k WINDOW w AS (PARTITION BY chunk_id ORDER BY ord)), c AS (SELECT r.chunk_id, r.ord, coalesce(a.name, {_TRIM('sn')}) AS s, coalesce(b.name, {_TRIM('xn')}) AS o FROM r LEFT JOIN m a ON a.key = sk LEFT JOIN m b ON b.key = xk WHERE xn IS NOT NULL), rl AS (SELECT arg_min(s, (chunk_id, ord)) AS subject, 'RELATES_TO' AS predicate, arg_min(o, (chunk_id, ord)) AS object, count(*) AS n FROM c WHERE lower(s) <> lower(o) GROUP BY lower(s), lower(o)), dg AS (SELECT low, count(*) AS degree FROM (SELECT lower(subject) AS low FROM rl UNION ALL SELECT lower(object) FROM rl) GROUP BY low), mn AS (SELECT key, arg_min(name, (chunk_id, ord)) AS name, arg_min(type, (chunk_id, ord)) AS type, count(DISTINCT chunk_id) AS n_chunks FROM k WHERE key <> '' GROUP BY key) SELECT key, name, type, n_chunks, coalesce(degree, 0) AS degree FROM mn LEFT JOIN dg ON low = lower(name)",
    "relation_distinct": f"WITH {VIEWS}, e AS (SELECT v.*, l.ingested_at FROM edge_v v JOIN edge_l l USING (id) WHERE v.source <> v.target) SELECT arg_min(source, (ingested_at, id)) AS subject, arg_min(predicate, (ingested_at, id)) AS predicate, arg_min(target, (ingested_at, id)) AS object, count(*) AS n FROM e GROUP BY source, upper(predicate), target",
    "node_texts": f"WITH {VIEWS} SELECT id, CASE WHEN trim(coalesce(description, '')) <> '' THEN name || ': ' || description ELSE name END AS text FROM node_l WHERE name IS NOT NULL",
    "community_search": "WITH p AS (SELECT id, len(l) AS length, unnest(l) AS term FROM (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', name, summary, themes)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS l FROM communities)), f AS (SELECT id, term, length, count(*) AS tf FROM p GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM communities) AS n, (SELECT sum(tf) FROM f) / (SELECT count(*) FROM communities)::DOUBLE AS mean), w AS (SELECT term, mean, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM (SELECT term, count(*) AS df FROM f WHERE term IN ('vector', 'graph', 'index') GROUP BY term), st) SELECT id AS chunk_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM f JOIN w USING (term) GROUP BY id",
    "postings": f"WITH {VIEWS}, {_POST} SELECT * FROM post",
    "doc_freq": f"WITH {VIEWS}, {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "bm25_search": f"WITH {VIEWS}, {_POST}, st AS (SELECT (SELECT count(*) FROM chunk_l) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM chunk_l)::DOUBLE AS mean), q AS (SELECT term, count(*) AS df FROM post WHERE term IN ('graph', 'vector', 'query') GROUP BY term), w AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf, mean FROM q, st) SELECT chunk_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM post JOIN w USING (term) GROUP BY chunk_id HAVING count(*) = 3 ORDER BY score DESC, chunk_id LIMIT 50",
    "vector_topk": f"WITH {_SIMS} SELECT query_id, vec_id, round(s, 5) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM sims) WHERE r <= 10",
    "semantic_links": f"WITH {_SIMS} SELECT query_id, vec_id, round(s, 4) AS score FROM sims WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 1000",
    "vector_remove": "SELECT vec_id, label FROM embeddings WHERE label <> 1 OR label IS NULL",
    "mean_pairwise_cosine": "WITH n AS (SELECT label, unnest(embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), s AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM n GROUP BY label, pos) SELECT label, max(n) AS n, CASE WHEN max(n) > 1 THEN round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 4) ELSE 1.0 END AS mean_cosine FROM s GROUP BY label",
}
