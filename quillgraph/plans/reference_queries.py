"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import references
from quillgraph.session import cut
from quillgraph.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every broken reference."""
    return references.orphans(*(table(spark, d, t) for t in ("notes", "chunks", "nodes", "edges")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, field, month and kind."""
    return references.orphan_report(p3_found(spark, d))


def p3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Every broken reference, kept up by changes: a state of the rows that landed in the first half of the time, then the
    deltas of what came later and of the notes that were removed later (their former rows go, their removed rows come)."""
    notes, chunks, nodes, edges = (table(spark, d, t) for t in ("notes", "chunks", "nodes", "edges"))
    ends = notes.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    half = F.lit(None if ends[0] is None else ends[0] + (ends[1] - ends[0]) / 2).cast("timestamp_ntz")
    then = lambda df: df.where(F.coalesce(F.col("ingested_at") <= half, F.lit(False)))
    later = lambda df: df.where(~F.coalesce(F.col("ingested_at") <= half, F.lit(False)))
    removed = then(notes).where(F.col("deleted_at") > half)
    former = removed.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    before = then(notes).where(F.col("deleted_at").isNull() | (F.col("deleted_at") <= half)).unionByName(former)
    records = cut(references.added_up(references.record_deltas(before, then(chunks), then(nodes))), "p3-stored")
    refs = cut(references.added_up(references.reference_deltas(then(chunks), then(nodes), then(edges))), "p3-stored")
    none = chunks.limit(0), nodes.limit(0)
    change = references.record_deltas(later(notes).unionByName(removed), later(chunks), later(nodes)).unionByName(references.record_deltas(former, *none, sign=-1))
    return references.orphans_of(references.changed(records, change), references.changed(refs, references.reference_deltas(later(chunks), later(nodes), later(edges))))


_FOUND = r"""
WITH note AS (SELECT lower(trim(id)) AS k, min(ingested_at) AS at, bool_or(deleted_at IS NOT NULL) AS gone FROM notes GROUP BY 1),
chunk AS (SELECT lower(trim(c.id)) AS k, min(c.ingested_at) AS at, bool_or(coalesce(n.gone, false)) AS gone FROM chunks c LEFT JOIN note n ON lower(trim(c.note_id)) = n.k GROUP BY 1),
node AS (SELECT lower(trim(id)) AS k, min(ingested_at) AS at, false AS gone FROM nodes GROUP BY 1),
target AS (SELECT 'notes' AS t, * FROM note UNION ALL SELECT 'chunks', * FROM chunk UNION ALL SELECT 'nodes', * FROM node),
refs AS (
  SELECT 'chunks' AS tbl, 'note_id' AS field, id AS record_id, 'notes' AS t, lower(trim(note_id)) AS ref_id FROM chunks
  UNION SELECT 'nodes', 'provenance', id, 'chunks', lower(trim(unnest(string_split_regex(regexp_replace(provenance, '[\[\]"'']', '', 'g'), '[,;]')))) FROM nodes
  UNION SELECT 'edges', 'source', id, 'nodes', lower(trim(source)) FROM edges
  UNION SELECT 'edges', 'target', id, 'nodes', lower(trim(target)) FROM edges),
seen AS (
  SELECT 'chunks' AS tbl, id AS record_id, min(ingested_at) AS seen FROM chunks GROUP BY 2
  UNION ALL SELECT 'nodes', id, min(ingested_at) FROM nodes GROUP BY 2
  UNION ALL SELECT 'edges', id, min(ingested_at) FROM edges GROUP BY 2),
found AS (
  SELECT r.tbl, r.field, r.record_id, r.ref_id,
    CASE WHEN g.k IS NULL THEN 'missing' WHEN g.gone THEN 'deleted' WHEN g.at > s.seen THEN 'late' END AS kind, strftime(s.seen, '%Y-%m') AS period
  FROM refs r JOIN seen s USING (tbl, record_id) LEFT JOIN target g ON g.t = r.t AND g.k = r.ref_id
  WHERE r.ref_id <> '')
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_incremental": p3_incremental}
ORACLE = {
    "p3_found": _FOUND + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p3_incremental": _FOUND + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p3_report": _FOUND + "SELECT tbl, field, period, kind, count(*) AS n_refs, count(DISTINCT ref_id) AS n_keys FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
