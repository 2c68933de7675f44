"""Views of the stored tables: latest rows, soft deletion, incident edges, upsert and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.references import key, listed_keys
from quillgraph.session import lookup


def latest(df: DataFrame, *columns: str, by: str = "id", at: str = "ingested_at") -> DataFrame:
    """The columns of each id's latest row (the last write wins); combines before the shuffle.  Null ids are left out.

    For columns of keys and numbers; whole texts are better served by :func:`latest_texts`.
    """
    pick = F.max_by(F.struct(*columns), F.struct(at, *[c for c in columns if c != at]))
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(pick.alias("_row")).select(by, *[F.col("_row")[c].alias(c) for c in columns if c != by])


def latest_texts(df: DataFrame, *columns: str, by: str = "id", at: str = "ingested_at") -> DataFrame:
    """As :func:`latest`, for wide columns: only the rows of ids that occur more than once are aggregated and shuffled.

    A count per id finds those ids first and reads the ids alone; all other rows pass as they are.
    """
    named = df.where(F.col(by).isNotNull())
    several = lookup(named.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").select(by), label="several")
    once = named.join(several, by, "left_anti").select(by, *[c for c in columns if c != by])
    return once.unionByName(latest(named.join(several, by, "left_semi"), *columns, by=by, at=at))


def upsert(old: DataFrame, new: DataFrame, by: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` written over those of the same key; columns that one side lacks become null."""
    return old.join(new.select(by), by, "left_anti").unionByName(new, allowMissingColumns=True)


def rows_of(df: DataFrame, ids: DataFrame, by: str = "id") -> DataFrame:
    """The rows of a list of ids, in any case and padding (a lookup of one is a list of one)."""
    return df.join(ids.select(key(by).alias("_k")).distinct(), key(by) == F.col("_k"), "left_semi")


def updated_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with title and content of ``changes`` ``(id, title, raw_content)`` written over theirs; a null leaves the old.
    Of several values for an id the greatest counts."""
    new = changes.groupBy("id").agg(F.max("title").alias("_t"), F.max("raw_content").alias("_c"))
    return notes.join(new, "id", "left").withColumn("title", F.coalesce("_t", "title")).withColumn("raw_content", F.coalesce("_c", "raw_content")).drop("_t", "_c")


def updated_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks of changed notes ``(id, raw_content)``: each has the note's whole new text (of several the greatest)."""
    new = changes.where("raw_content IS NOT NULL").groupBy(key("id").alias("_k")).agg(F.max("raw_content").alias("_c"))
    return chunks.join(new, key("note_id") == F.col("_k"), "left").withColumn("text", F.coalesce("_c", "text")).drop("_k", "_c")


def placed_nodes(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """Nodes with the coordinates of ``layout`` ``(id, x, y)``; an id without a node becomes a node of the type NOTE.
    Of several places for an id the greatest counts."""
    put = layout.groupBy("id").agg(F.max(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")
    moved = nodes.join(put, "id", "left").withColumn("layout_x", F.coalesce("x", "layout_x")).withColumn("layout_y", F.coalesce("y", "layout_y")).drop("x", "y")
    new = put.join(nodes.select("id"), "id", "left_anti").select("id", F.col("id").alias("name"), F.lit("NOTE").alias("type"), F.col("x").alias("layout_x"), F.col("y").alias("layout_y"))
    return moved.unionByName(new, allowMissingColumns=True)


def soft_delete(notes: DataFrame, ids: DataFrame, when: Column, by: str = "id") -> DataFrame:
    """Notes with ``deleted_at`` set for the given ids; an unknown id becomes a bare removed row (tombstone)."""
    gone = ids.select(F.regexp_replace(by, r"\.md$", "").alias(by)).distinct()
    marked = notes.join(gone.withColumn("_gone", F.lit(True)), by, "left").withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", when)).otherwise(F.col("deleted_at"))).drop("_gone")
    unknown = gone.join(notes.select(by), by, "left_anti").withColumn("deleted_at", when)
    return marked.unionByName(unknown, allowMissingColumns=True)


def restore(notes: DataFrame, ids: DataFrame, by: str = "id") -> DataFrame:
    """Notes with ``deleted_at`` cleared for the given ids."""
    back = ids.select(F.regexp_replace(by, r"\.md$", "").alias(by)).distinct().withColumn("_back", F.lit(True))
    return notes.join(back, by, "left").withColumn("deleted_at", F.when(F.col("_back"), None).otherwise(F.col("deleted_at"))).drop("_back")


def deleted_notes(notes: DataFrame) -> DataFrame:
    """``(note)``: keys of the notes whose latest row is removed."""
    return latest(notes, "deleted_at", "ingested_at").where("deleted_at IS NOT NULL").select(key("id").alias("note")).distinct()


def deleted_chunks(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """``(chunk)``: keys of the chunks whose latest row leads to a removed note."""
    rows = latest(chunks, "note_id", "ingested_at").select(key("id").alias("chunk"), key("note_id").alias("note"))
    return rows.join(deleted_notes(notes), "note", "left_semi").select("chunk").distinct()


def provenance(df: DataFrame) -> DataFrame:
    """``(id, chunk)`` of the latest rows' lists, each once."""
    return latest(df, "provenance", "ingested_at").select("id", F.explode(listed_keys("provenance")).alias("chunk"))


def surviving(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``(id, n_before, n_left)`` of rows that keep a chunk of their provenance, or never had one.

    The lists are exploded and met by an anti join, so no task reads a whole list of removed chunks.
    """
    ids = df.where("id IS NOT NULL").select("id").distinct()
    had = provenance(df).join(gone.withColumn("_gone", F.lit(1)), "chunk", "left").groupBy("id").agg(F.count("*").alias("n_before"), F.sum(F.when(F.col("_gone").isNull(), 1).otherwise(0)).alias("n_left"))
    return ids.join(had, "id", "left").select("id", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_left", F.lit(0)).alias("n_left")).where("n_before = 0 OR n_left > 0")


def active_nodes(nodes: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """``(id, n_before, n_left)`` of the nodes that removed notes leave visible."""
    return surviving(nodes, deleted_chunks(chunks, notes))


def edge_view(edges: DataFrame) -> DataFrame:
    """Latest edges with keys as ends; a missing or zero weight or confidence reads as 1 (``weighted`` says whether it was stated)."""
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c)).alias(c)
    return latest(edges, "source", "target", "predicate", "weight", "confidence", "provenance", "ingested_at").select("id", key("source").alias("source"), key("target").alias("target"), "predicate", one("weight"), one("confidence"), "provenance", "ingested_at", (F.coalesce("weight", F.lit(0.0)) != 0).alias("weighted"))


def active_edges(edges: DataFrame, nodes: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """``(id, source, target, predicate, weight, n_left)`` of edges with both ends and their provenance visible."""
    gone = deleted_chunks(chunks, notes)
    keep = surviving(nodes, gone).select(key("id").alias("k")).distinct()
    kept = surviving(edges, gone)
    view = edge_view(edges).join(keep.withColumnRenamed("k", "source"), "source", "left_semi").join(keep.withColumnRenamed("k", "target"), "target", "left_semi")
    return view.join(kept, "id").select("id", "source", "target", "predicate", "weight", "n_left")


def community_members(communities: DataFrame) -> DataFrame:
    """``(id, level, parent_id, pos, node)``: members in the order of the list."""
    ids = F.from_json("node_ids", "array<string>")
    return communities.select("id", "level", "parent_id", F.posexplode(ids).alias("pos", "node")).withColumn("node", key("node"))


def active_communities(communities: DataFrame, visible: DataFrame) -> DataFrame:
    """``(id, level, n_members, n_active)``; communities without a visible member are left out."""
    shown = visible.select(key("id").alias("node")).distinct().withColumn("_on", F.lit(1))
    return community_members(communities).join(shown, "node", "left").groupBy("id", "level").agg(F.count("*").alias("n_members"), F.count("_on").alias("n_active")).where("n_active > 0")


def _purged(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``(id, provenance)``: rows that keep a chunk of their provenance, or never had one, with what is left of the list."""
    left = provenance(df).join(gone, "chunk", "left_anti").groupBy("id").agg(F.to_json(F.array_sort(F.collect_list("chunk"))).alias("provenance"))
    return surviving(df, gone).select("id").join(left, "id", "left").select("id", F.coalesce("provenance", F.lit("[]")).alias("provenance"))


def purge(nodes: DataFrame, edges: DataFrame, communities: DataFrame, chunks: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """The tables without the removed notes and all that came from them alone.

    ``notes`` and ``chunks``: the rows that stay; ``nodes``: ``(id, provenance, degree)``, degrees counted anew, a loop
    once; ``edges``: ``(id, source, target, provenance)`` without those of a purged node or of purged chunks alone;
    ``communities``: ``(id, node_ids)`` without purged nodes, emptied ones left out.  Ends and members that no row
    describes stay.
    """
    gone = lookup(deleted_chunks(chunks, notes), label="gone")
    left = _purged(nodes, gone)
    lost = nodes.where("id IS NOT NULL").select("id").distinct().join(left.select("id"), "id", "left_anti").select(key("id").alias("node")).distinct()
    lost = lookup(lost, label="lost")
    at = lambda c: lost.withColumnRenamed("node", c)
    kept = edge_view(edges).select("id", "source", "target").join(at("source"), "source", "left_anti").join(at("target"), "target", "left_anti").join(_purged(edges, gone), "id").select("id", "source", "target", "provenance")
    counts = degrees(kept, loops_twice=False)
    members = community_members(communities).join(lost, "node", "left_anti").groupBy("id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])).alias("node_ids"))
    return {
        "notes": notes.join(deleted_notes(notes).withColumnRenamed("note", "_k"), key("id") == F.col("_k"), "left_anti"),
        "chunks": chunks.join(gone.withColumnRenamed("chunk", "_k"), key("id") == F.col("_k"), "left_anti"),
        "nodes": left.withColumn("node", key("id")).join(counts, "node", "left").select("id", "provenance", F.coalesce("degree", F.lit(0)).alias("degree")),
        "edges": kept,
        "communities": members,
    }


def purge_counts(nodes: DataFrame, edges: DataFrame, communities: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of what a purge of the removed notes takes away: notes, chunks, nodes, edges and emptied communities."""
    stays = purge(nodes, edges, communities, chunks, notes)
    gone = deleted_chunks(chunks, notes)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    lost = lambda df, name: df.where("id IS NOT NULL").select("id").distinct().join(stays[name].select("id"), "id", "left_anti")
    lost_nodes, lost_edges, emptied = lost(nodes, "nodes"), lost(edges, "edges"), lost(communities, "communities")
    parts = [count(deleted_notes(notes), "notes"), count(gone, "chunks"), count(lost_nodes, "nodes"), count(lost_edges, "edges"), count(emptied, "communities")]
    named = [p.select(F.lit(p.columns[0]).alias("what"), F.col(p.columns[0]).alias("n")) for p in parts]
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p)
    return out


def node_search(nodes: DataFrame, text: str, k: int) -> DataFrame:
    """The ``k`` nodes of highest degree whose name or description holds the text, in any case."""
    rows = latest(nodes, "name", "type", "description", "degree", "ingested_at")
    hit = F.lower("name").contains(text.lower()) | F.lower(F.coalesce("description", F.lit(""))).contains(text.lower())
    return rows.where(hit).select("id", "name", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def incident_edges(view: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a node of ``seeds`` (column ``node``), each once."""
    ends = view.select("id", "source", "target", "predicate", "weight", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return ends.join(seeds.select("node").distinct(), "node", "left_semi").drop("node").dropDuplicates(["id"])


def degrees(view: DataFrame, loops_twice: bool = True) -> DataFrame:
    """``(node, degree)`` over all edges, parallel ones counted; a loop counts twice, or once as after a purge."""
    ends = F.array("source", "target")
    return view.select(F.explode(ends if loops_twice else F.array_distinct(ends)).alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("degree"))


def graph_nodes(nodes: DataFrame, view: DataFrame) -> DataFrame:
    """``(node, type, ghost)``: all nodes, and ends of edges that no row describes (as plain concepts)."""
    own = latest(nodes, "type", "ingested_at").select(key("id").alias("node"), F.upper(F.trim(F.coalesce("type", F.lit("CONCEPT")))).alias("type"), F.lit(False).alias("ghost"))
    ends = view.select(F.explode(F.array("source", "target")).alias("node")).where("node IS NOT NULL").distinct()
    return own.unionByName(ends.join(own.select("node"), "node", "left_anti").select("node", F.lit("CONCEPT").alias("type"), F.lit(True).alias("ghost")))
