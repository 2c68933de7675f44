"""Queries on changed notes and nodes, texts written anew and pages laid out, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as x
from quillgraph.operators import classify, extraction, page_layout, vault
from quillgraph.operators import vault_reports as reports
from quillgraph.operators.references import key
from quillgraph.plans.report_queries import _topics_sql, classify_topics
from quillgraph.plans.text_queries import _ENT, extract_entities
from quillgraph.plans.vault_queries import VIEWS
from quillgraph.sources.tables import table as t

_WHEN = "2030-01-01 00:00:00"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return vault.latest_texts(t(spark, d, "notes"), "title", "source_type", "raw_content", "deleted_at", "ingested_at")


def updated_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the corrected texts written over theirs."""
    changes = t(spark, d, "page_corrections").select(F.col("note_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("corrected_text").alias("raw_content"))
    return vault.updated_notes(_notes(spark, d), changes).select("id", "title", F.md5(F.col("raw_content").cast("binary")).alias("content_hash"))


def updated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the corrected text of their note."""
    chunks = vault.latest_texts(t(spark, d, "chunks"), "note_id", "text", "ingested_at")
    changes = t(spark, d, "page_corrections").select(F.col("note_id").alias("id"), F.col("corrected_text").alias("raw_content"))
    return vault.updated_chunks(chunks, changes).select("id", F.md5(F.col("text").cast("binary")).alias("text_hash"))


def soft_deleted_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes after the removal of those without a chunk."""
    notes = vault.latest(t(spark, d, "notes"), "deleted_at", "ingested_at")
    bare = notes.join(t(spark, d, "chunks").select(key("note_id").alias("_k")).distinct(), key("id") == F.col("_k"), "left_anti")
    after = vault.soft_delete(notes, bare, F.lit(_WHEN).cast("timestamp_ntz"))
    return after.select("id", F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss").alias("deleted_at"))


def restored_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes after all removed ones are put back, each with whether it had been removed."""
    notes = vault.latest(t(spark, d, "notes"), "deleted_at", "ingested_at")
    gone = notes.where("deleted_at IS NOT NULL")
    after = vault.restore(notes.withColumn("was_deleted", F.col("deleted_at").isNotNull()), gone)
    return after.select("id", "was_deleted", F.col("deleted_at").isNull().alias("is_active"))


def upserted_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the first half of the time with those of the second written over them."""
    nodes = t(spark, d, "nodes")
    ends = nodes.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    half = F.lit(None if ends[0] is None else ends[0] + (ends[1] - ends[0]) / 2).cast("timestamp_ntz")
    first = F.coalesce(F.col("ingested_at") <= half, F.lit(True))
    state = lambda rows: vault.latest(rows, "name", "type", "ingested_at")
    return vault.upsert(state(nodes.where(first)), state(nodes.where(~first))).select("id", "name", "type")


def placed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their normal layout written back, and a node of the type NOTE in the centre for every active note."""
    nodes = vault.latest(t(spark, d, "nodes"), "name", "type", "layout_x", "layout_y", "ingested_at")
    notes = vault.latest(t(spark, d, "notes"), "deleted_at", "ingested_at").where("deleted_at IS NULL")
    layout = reports.normal_layout(nodes).unionByName(notes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return vault.placed_nodes(nodes, layout).select("id", "name", "type", "layout_x", "layout_y")


def note_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nodes drawn from each active note, by the note part of their chunks' keys."""
    notes = vault.latest(t(spark, d, "notes"), "title", "deleted_at", "ingested_at").where("deleted_at IS NULL")
    nodes = vault.latest(t(spark, d, "nodes"), "name", "type", "ingested_at")
    return reports.note_entities(notes, nodes, vault.provenance(t(spark, d, "nodes")))


def note_topics(spark: SparkSession, d: str) -> DataFrame:
    """The leading topic of each active note."""
    return classify.leading_topic(classify.topic_scores(_notes(spark, d).where("deleted_at IS NULL"), "id", "raw_content"))


def topic_bars(spark: SparkSession, d: str) -> DataFrame:
    return classify_topics(spark, d).select("id", "topic", classify.bar(F.col("percent")).alias("bar"))


def unfenced_texts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", x.unfenced("text").alias("text"))


def linked_titles(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose content holds their title, with the first place of it made a link."""
    linked = x.replaced_once("raw_content", "title", F.concat(F.lit("[["), "title", F.lit("]]")))
    return _notes(spark, d).select("id", linked.alias("content")).where("content IS NOT NULL")


def filled_templates(spark: SparkSession, d: str) -> DataFrame:
    """A heading for each note from a template; a name that has no value becomes dots."""
    values = F.create_map(F.lit("title"), F.col("title"), F.lit("kind"), F.col("source_type"))
    return _notes(spark, d).select("id", x.filled(F.lit("# {title} ({kind}, {author})"), values).alias("content"))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """``(page_id, line, text)``: lines of scanned notes, a page for each ``## Page``."""
    body = vault.latest_texts(t(spark, d, "notes"), "raw_content", "ingested_at").where(F.col("raw_content").contains("\n## Page"))
    parts = F.split("raw_content", "\n## Page")
    pages = body.select("id", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("page", "text"))
    return pages.select(F.concat("id", F.lit("#"), (F.col("page") + 1).cast("string")).alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Words of scanned notes as segments: a line a unit high, a sign a unit wide."""
    # exploded, the parts of a line are split once, not for each of them
    parts = _page_lines(spark, d).select("page_id", "line", F.explode(F.array(F.split("text", r"(?<=[^ ])(?= )|(?<= )(?=[^ ])"))).alias("parts"))
    # a word begins where the length of all that stands before it ends
    words = parts.select("page_id", "line", F.posexplode(F.transform("parts", lambda p, i: F.struct(p.alias("text"), F.length(F.array_join(F.slice("parts", F.lit(1), i), "")).alias("x")))).alias("k", "s"))
    return words.where(F.trim("s.text") != "").select("page_id", (F.col("line").cast("bigint") * 100_000 + F.col("k")).alias("seg_id"), F.col("s.text").alias("text"), F.lit(100.0).alias("confidence"), F.col("s.x").cast("double").alias("x"), F.col("line").cast("double").alias("y"), F.length("s.text").cast("double").alias("w"), F.lit(1.0).alias("h"))


def _line_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned notes as segments; their confidence is the share of letters and digits."""
    lines = _page_lines(spark, d).where(F.trim("text") != "")
    known = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) * 100.0 / F.length(F.trim("text"))
    return lines.select("page_id", F.col("line").cast("bigint").alias("seg_id"), F.trim("text").alias("text"), known.alias("confidence"), (F.length("text") - F.length(F.ltrim("text"))).cast("double").alias("x"), F.col("line").cast("double").alias("y"), F.length(F.trim("text")).cast("double").alias("w"), F.lit(1.0).alias("h"))


def page_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows and cells of the pages of scanned notes, from the places of their words."""
    return page_layout.cells(_segments(spark, d))


def page_buckets(spark: SparkSession, d: str) -> DataFrame:
    return page_layout.confidence_buckets(_line_segments(spark, d))


def page_doubts(spark: SparkSession, d: str) -> DataFrame:
    return page_layout.doubtful(_line_segments(spark, d)).where("doubt IS NOT NULL").select("page_id", "seg_id", "text", "doubt")


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return page_layout.markdown(_line_segments(spark, d))


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Entities read back from answers in JSON, fenced and with words around it, made of what each chunk names."""
    entry = F.struct("ord", F.concat(F.lit(" "), "name").alias("name"), F.when(F.col("type") != "CONCEPT", F.lower("type")).alias("type"), F.col("confidence").cast("string").alias("confidence"))
    named = extract_entities(spark, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(entry)).alias("entities"))  # a chunk's names
    answers = named.select("chunk_id", F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("entities")), F.lit("\n```")).alias("answer"))
    return extraction.parse_answers(answers)[0].select("chunk_id", "ord", "name", "type", "confidence")


QUERIES = {
    f.__name__: f
    for f in (updated_notes, updated_chunks, soft_deleted_notes, restored_notes, upserted_nodes, placed_nodes, note_entities, note_topics, topic_bars, unfenced_texts, linked_titles, filled_templates, page_cells, page_buckets, page_doubts, page_markdown, parsed_answers)
}

_TOPIC = _topics_sql()
_LAYOUT = "p AS (SELECT id, layout_x, layout_y FROM node_l WHERE layout_x IS NOT NULL AND layout_y IS NOT NULL), b AS (SELECT min(layout_x) AS ax, max(layout_x) AS bx, min(layout_y) AS ay, max(layout_y) AS by_, greatest(max(layout_x) - min(layout_x), max(layout_y) - min(layout_y)) / 2 AS s FROM p), lay AS (SELECT id, round(CASE WHEN s > 0 THEN (layout_x - (ax + bx) / 2) / s * 1000 ELSE 0 END, 2) AS x, round(CASE WHEN s > 0 THEN (layout_y - (ay + by_) / 2) / s * 1000 ELSE 0 END, 2) AS y FROM p, b)"
_PAGES = r"pg AS (SELECT page_id, line, text FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM (SELECT id || '#' || page AS page_id, text FROM (SELECT id, unnest(ps) AS text, unnest(range(len(ps))) AS page FROM (SELECT id, string_split(raw_content, chr(10) || '## Page') AS ps FROM note_l WHERE contains(raw_content, chr(10) || '## Page'))) WHERE page > 0)) WHERE trim(text, ' ') <> ''), sg AS (SELECT page_id, line, trim(text, ' ') AS text, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) * 100.0::DOUBLE / length(trim(text, ' ')) AS c FROM pg)"
_MORE = {"placed_nodes": _LAYOUT, "page_cells": _PAGES, "page_buckets": _PAGES, "page_doubts": _PAGES, "page_markdown": _PAGES}
_SQL = {
    "updated_notes": "SELECT n.id, n.title, md5(coalesce(c.corrected_text, n.raw_content)) AS content_hash FROM note_l n LEFT JOIN page_corrections c ON c.note_id = n.id",
    "updated_chunks": "SELECT k.id, md5(coalesce(c.corrected_text, k.text)) AS text_hash FROM chunk_l k LEFT JOIN page_corrections c ON lower(trim(k.note_id)) = lower(trim(c.note_id))",
    "soft_deleted_notes": f"SELECT id, strftime(CASE WHEN lower(trim(id)) NOT IN (SELECT lower(trim(note_id)) FROM chunks WHERE note_id IS NOT NULL) THEN coalesce(deleted_at, TIMESTAMP '{_WHEN}') ELSE deleted_at END, '%Y-%m-%d %H:%M:%S') AS deleted_at FROM note_l",
    "restored_notes": "SELECT id, deleted_at IS NOT NULL AS was_deleted, true AS is_active FROM note_l",
    "upserted_nodes": "SELECT id, name, type FROM node_l",
    "placed_nodes": "SELECT n.id, n.name, n.type, coalesce(l.x, n.layout_x) AS layout_x, coalesce(l.y, n.layout_y) AS layout_y FROM node_l n LEFT JOIN lay l USING (id) UNION ALL SELECT id, id, 'NOTE', 0.0::DOUBLE, 0.0::DOUBLE FROM note_l WHERE deleted_at IS NULL",
    "note_entities": "SELECT DISTINCT n.id, n.title, e.id AS entity_id, e.name AS entity_name, e.type AS entity_type FROM note_l n JOIN node_p p ON lower(trim(n.id)) = regexp_replace(p.chunk, '_chunk_[^_]*$', '') JOIN node_l e ON e.id = p.id WHERE n.deleted_at IS NULL",
    "unfenced_texts": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT fence AND before % 2 = 0), '') END AS text FROM (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, text, line, i, trim(line, ' ') = '---' AS fence FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id, text UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "linked_titles": "SELECT id, substr(raw_content, 1, instr(raw_content, title) - 1) || '[[' || title || ']]' || substr(raw_content, instr(raw_content, title) + length(title)) AS content FROM note_l WHERE title <> '' AND contains(raw_content, title)",
    "filled_templates": "SELECT id, '# ' || coalesce(title, '') || ' (' || coalesce(source_type, '') || ', ...)' AS content FROM note_l",
    "page_cells": "SELECT page_id, row, unnest(range(len(cs))) AS cell, unnest(cs) AS text FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line) - 1 AS row, string_split_regex(trim(text, ' '), '  +') AS cs FROM pg)",
    "page_buckets": "SELECT page_id, count(*) AS n, count(*) FILTER (WHERE c >= 80) AS high, count(*) FILTER (WHERE c >= 60 AND c < 80) AS medium, count(*) FILTER (WHERE c < 60) AS low, round(avg(c), 2) AS mean FROM sg GROUP BY page_id",
    "page_doubts": "SELECT * FROM (SELECT page_id, line AS seg_id, text, CASE WHEN c < 60 THEN 'low' WHEN regexp_matches(text, '[^\\p{L}\\p{N}\\s.,;:!?()''\"-]{3,}') THEN 'signs' END AS doubt FROM sg) WHERE doubt IS NOT NULL",
    "page_markdown": f"SELECT page_id, string_agg(opens || CASE WHEN regexp_matches(text, '{page_layout.LIST_MARK}') THEN '- ' || regexp_replace(text, '{page_layout.LIST_MARK}', '') ELSE text END, '' ORDER BY line) AS text FROM (SELECT *, CASE WHEN lag(line) OVER w IS NULL THEN '' WHEN line - lag(line) OVER w > 2.2 THEN chr(10) || chr(10) ELSE chr(10) END AS opens FROM sg WINDOW w AS (PARTITION BY page_id ORDER BY line)) GROUP BY page_id",
}
ORACLE = {k: f"WITH {VIEWS} {', ' + _MORE[k] if k in _MORE else ''} {v}" for k, v in _SQL.items()} | {
    "note_topics": f"WITH {VIEWS}, documents AS (SELECT id AS doc_id, raw_content AS text FROM note_l WHERE deleted_at IS NULL), {_TOPIC} SELECT id, topic, percent FROM tp QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) = 1",
    "parsed_answers": f"WITH {VIEWS}, {_ENT} SELECT chunk_id, ord - 1 AS ord, name, type, confidence FROM ent",
    "topic_bars": f"WITH {_TOPIC} SELECT id, topic, repeat('█', round_even(least(greatest(percent, 0), 100) / 100 * 20, 0)::BIGINT) || repeat('░', 20 - round_even(least(greatest(percent, 0), 100) / 100 * 20, 0)::BIGINT) AS bar FROM tp",
}
