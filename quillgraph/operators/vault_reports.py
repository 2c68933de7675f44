"""Listings, exports, layout and conversation windows over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import preview, tag_list, words
from quillgraph.operators.references import key

RESOURCE, PREDICATE = "http://example.org/resource/", "http://example.org/predicate/"
#: The angle between successive points of a sunflower spiral, in degrees.
GOLDEN_ANGLE = 137.507764


def note_listing(notes: DataFrame, prov: DataFrame) -> DataFrame:
    """``(id, title, n_words, n_chars, preview, n_tags, n_entities)`` of notes; entities are counted by the note part of
    their chunks' keys."""
    counts = prov.select(F.regexp_replace("chunk", r"_chunk_[^_]*$", "").alias("note"), "id").distinct().groupBy("note").agg(F.count("*").alias("n_entities"))
    text = F.coalesce("raw_content", F.lit(""))
    rows = notes.select("id", key("id").alias("note"), "title", F.size(words(text)).cast("bigint").alias("n_words"), F.length(text).cast("bigint").alias("n_chars"), preview(text).alias("preview"), F.size(tag_list("tags")).cast("bigint").alias("n_tags"))
    return rows.join(counts, "note", "left").select("id", "title", "n_words", "n_chars", "preview", "n_tags", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def note_entities(notes: DataFrame, nodes: DataFrame, prov: DataFrame) -> DataFrame:
    """``(id, title, entity_id, entity_name, entity_type)``: the nodes drawn from each note, once each."""
    drawn = prov.select(F.regexp_replace("chunk", r"_chunk_[^_]*$", "").alias("note"), F.col("id").alias("entity_id")).distinct()
    named = nodes.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"))
    own = notes.select("id", key("id").alias("note"), "title")
    return own.join(drawn, "note").join(named, "entity_id").select("id", "title", "entity_id", "entity_name", "entity_type")


def gallery_search(notes: DataFrame, text: str) -> DataFrame:
    """``(id)`` of notes whose title, preview or tags hold the text, in any case."""
    low = text.lower()
    return notes.where(F.lower(F.coalesce("title", F.lit(""))).contains(low) | F.lower(preview(F.coalesce("raw_content", F.lit("")))).contains(low) | F.exists(tag_list("tags"), lambda x: F.lower(x).contains(low))).select("id")


def content_keys(notes: DataFrame) -> DataFrame:
    """``(content_key, n, first_id)``: notes by the beginning of the hash of their content; equal contents share a key."""
    return notes.where("raw_content IS NOT NULL").select("id", F.substring(F.sha2(F.col("raw_content").cast("binary"), 256), 1, 16).alias("content_key")).groupBy("content_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def last_messages(rows: DataFrame, session: str, order: list[str], keep: int = 12) -> DataFrame:
    """The last ``keep`` rows of each session with their place, the oldest first."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(*[F.desc(c) for c in order]))
    kept = rows.withColumn("_back", back).where(F.col("_back") <= keep)
    return kept.withColumn("place", (F.count("*").over(Window.partitionBy(session)) - F.col("_back") + 1).cast("bigint")).drop("_back")


def history(rows: DataFrame, session: str, order: list[str], text: Column, keep: int = 6) -> DataFrame:
    """``(session, n, history)``: the last ``keep`` rows of a session as one text, a line each."""
    last = last_messages(rows.select(session, *order, text.alias("line")), session, order, keep)
    return last.groupBy(session).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("history"))


def turtle(nodes: DataFrame, view: DataFrame) -> DataFrame:
    """``(line)``: one statement a row; quotes and backslashes in labels are escaped."""
    safe = lambda c: F.regexp_replace(c, " ", "_")
    label = F.regexp_replace(F.regexp_replace("name", r"\\", r"\\\\"), '"', r'\\"')
    n = nodes.select(F.concat(F.lit("r:"), safe(key("id")), F.lit(" a r:"), safe(F.upper(F.trim("type"))), F.lit(' ; rdfs:label "'), label, F.lit('" .')).alias("line"))
    e = view.select(F.concat(F.lit("r:"), safe(F.col("source")), F.lit(" p:"), safe(F.lower("predicate")), F.lit(" r:"), safe(F.col("target")), F.lit(" .")).alias("line"))
    return n.unionByName(e).where("line IS NOT NULL")


def flat_records(nodes: DataFrame, view: DataFrame) -> DataFrame:
    """Nodes and edges as rows of one table for CSV."""
    n = nodes.select(F.lit("node").alias("record_type"), "id", F.col("name").alias("source_or_name"), F.col("type").alias("target_or_type"), F.coalesce("description", F.lit("")).alias("relation_or_desc"), F.lit(1.0).alias("weight"))
    e = view.select(F.lit("edge").alias("record_type"), "id", F.col("source").alias("source_or_name"), F.col("target").alias("target_or_type"), F.col("predicate").alias("relation_or_desc"), "weight")
    return n.unionByName(e)


def linked_data(nodes: DataFrame) -> DataFrame:
    """``(id, json)``: one JSON-LD object a node; empty fields are left out."""
    return nodes.select("id", F.to_json(F.struct(F.concat(F.lit(RESOURCE), "id").alias("@id"), "name", "type", "description")).alias("json"))


def digest(nodes: DataFrame, view: DataFrame, communities: DataFrame) -> DataFrame:
    """``(section, key, line)``: lines of a Markdown digest of nodes, edges and communities, in order of section and key."""
    n = nodes.select(F.lit(1).alias("section"), F.col("id").alias("key"), F.format_string("- **%s** (`%s`): %s", "name", "type", F.coalesce("description", F.lit("No description"))).alias("line"))
    e = view.select(F.lit(2).alias("section"), F.col("id").alias("key"), F.concat(F.lit("- "), "source", F.lit(" --["), "predicate", F.lit("]--> "), "target").alias("line"))
    c = communities.select(F.lit(3).alias("section"), F.col("id").cast("string").alias("key"), F.concat(F.lit("### "), F.coalesce("name", F.concat(F.lit("Community "), F.col("id").cast("string"))), F.lit(" (Level "), F.col("level").cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit("\n"), "summary"), F.lit(""))).alias("line"))
    return n.unionByName(e).unionByName(c).where("line IS NOT NULL")


def exported_notes(notes: DataFrame) -> DataFrame:
    """``(filename, content, size_bytes)`` of notes as files."""
    content = F.coalesce("raw_content", F.lit(""))
    return notes.select(F.concat("id", F.lit(".md")).alias("filename"), content.alias("content"), F.octet_length(content).cast("bigint").alias("size_bytes"))


def vector_metadata(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(dimension, n_vectors, n_ids)`` of a table of vectors."""
    return vectors.agg(F.max(F.size(vec_col)).cast("bigint").alias("dimension"), F.count(vec_col).alias("n_vectors"), F.countDistinct(id_col).alias("n_ids"))


def cleared(turns: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    """Conversations without those of the given sessions."""
    return turns.join(sessions.select(session).distinct(), session, "left_anti")


def nearest(nodes: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """``(query_id, id, distance)``: the nearest node of each stated node within a radius; of equally near ones the first by id."""
    found = neighbours_within(nodes, queries, radius)
    return found.groupBy("query_id").agg(F.min(F.struct("distance", "id")).alias("x")).select("query_id", "x.id", "x.distance")


def drawn_elements(nodes: DataFrame, view: DataFrame) -> DataFrame:
    """``(kind, id, json)``: elements of a drawn graph; a node has a position if it has both coordinates."""
    place = F.when(F.col("layout_x").isNotNull() & F.col("layout_y").isNotNull(), F.struct(F.col("layout_x").alias("x"), F.col("layout_y").alias("y")))
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "type", F.coalesce("degree", F.lit(0)).alias("degree")).alias("data"), place.alias("position"))).alias("json"))
    e = view.select(F.lit("edge").alias("kind"), "id", F.to_json(F.struct(F.struct("id", "source", "target", F.col("predicate").alias("label"), "weight").alias("data"))).alias("json"))
    return n.unionByName(e)


def normal_layout(nodes: DataFrame, size: float = 1000.0) -> DataFrame:
    """``(id, x, y)``: coordinates moved to the centre and scaled into ``[-size, size]``; nodes without both are left out."""
    rows = nodes.where("layout_x IS NOT NULL AND layout_y IS NOT NULL").select("id", "layout_x", "layout_y")
    span = rows.agg(*[f(c).alias(n) for f, c, n in ((F.min, "layout_x", "ax"), (F.max, "layout_x", "bx"), (F.min, "layout_y", "ay"), (F.max, "layout_y", "by"))])
    scale = F.greatest(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / 2
    at = lambda c, a, b: F.round(F.when(scale > 0, (F.col(c) - (F.col(a) + F.col(b)) / 2) / scale * size).otherwise(0.0), 2)
    return rows.crossJoin(F.broadcast(span)).select("id", at("layout_x", "ax", "bx").alias("x"), at("layout_y", "ay", "by").alias("y"))  # one row of bounds


def spiral_layout(degrees: DataFrame, leaf: int = 2, inner: float = 320.0, outer: float = 1000.0) -> DataFrame:
    """``(node, x, y)``: nodes of degree under ``leaf`` on a sunflower spiral between two radii.

    The place of a node is its rank in an order of 256 parts by a hash of the key, and of keys within them; the parts are
    counted first, so no single task sorts all nodes.
    """
    leaves = degrees.where(F.col("degree") < leaf).select("node", F.pmod(F.xxhash64("node"), F.lit(256)).alias("part"))
    before = leaves.groupBy("part").agg(F.count("*").alias("c"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = before.withColumn("from", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("all", F.sum("c").over(Window.partitionBy(F.lit(1))))
    placed = leaves.join(F.broadcast(offsets), "part").withColumn("i", F.col("from") + F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1)  # 256 rows
    r = F.sqrt(F.lit(inner * inner) + (F.col("i") + 0.5) / F.col("all") * (outer * outer - inner * inner))
    a = F.radians(F.col("i") * GOLDEN_ANGLE)
    return placed.select("node", "part", "i", F.round(r * F.cos(a), 2).alias("x"), F.round(r * F.sin(a), 2).alias("y"))


def neighbours_within(nodes: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """``(query_id, id, distance)``: nodes within a radius of stated nodes, by a join on grid cells of that width."""
    cell = lambda c: F.floor(F.col(c) / radius)
    pts = nodes.where("layout_x IS NOT NULL AND layout_y IS NOT NULL")
    own = pts.select("id", "layout_x", "layout_y", cell("layout_x").alias("cx"), cell("layout_y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    ask = queries.where("layout_x IS NOT NULL AND layout_y IS NOT NULL").select(F.col("id").alias("query_id"), F.col("layout_x").alias("qx"), F.col("layout_y").alias("qy"), cell("layout_x").alias("gx"), cell("layout_y").alias("gy"), around).select("query_id", "qx", "qy", (F.col("gx") + F.col("o.dx")).alias("cx"), (F.col("gy") + F.col("o.dy")).alias("cy"))
    d = F.hypot(F.col("layout_x") - F.col("qx"), F.col("layout_y") - F.col("qy"))
    return own.join(ask, ["cx", "cy"]).where(F.col("id") != F.col("query_id")).withColumn("distance", d).where(F.col("distance") <= radius).select("query_id", "id", F.round("distance", 4).alias("distance"))


def node_style(nodes: DataFrame) -> DataFrame:
    """``(id, radius, shade)``: a node's radius by its degree, and a shade from 0 to 11 by its community or name."""
    shade = F.coalesce(F.pmod(F.col("community_id"), F.lit(12)), F.pmod(F.length("name"), F.lit(12)).cast("bigint"))
    return nodes.select("id", F.round(3 + F.least(F.lit(5.0), F.log(F.coalesce("degree", F.lit(0)) + 1.0)), 4).alias("radius"), shade.cast("bigint").alias("shade"))


def rest_lengths(view: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(id, length)``: the length at rest of each edge of a drawn graph, shorter between nodes of high degree."""
    a, b = degrees.select(F.col("node").alias("source"), F.col("degree").alias("ds")), degrees.select(F.col("node").alias("target"), F.col("degree").alias("dt"))
    return view.where("source <> target").join(a, "source").join(b, "target").select("id", F.round(85 / F.sqrt(F.least("ds", "dt") + 1.0), 4).alias("length"))
