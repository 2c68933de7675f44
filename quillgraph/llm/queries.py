"""Queries of this subpackage for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import clusters, names, neardup, packing, reading, scans, tokens
from quillgraph.session import cut
from quillgraph.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of nodes in the same similarity cluster."""
    return clusters.cluster_pairs(clusters.cluster(table(spark, d, "nodes"))[1])


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each similarity cluster."""
    return clusters.describe(*clusters.cluster(table(spark, d, "nodes")))


def _texts(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"notes": (table(spark, d, "notes"), "id", "raw_content"), "chunks": (table(spark, d, "chunks"), "id", "text")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with which line of the scanned notes."""
    return scans.noisy_lines(table(spark, d, "notes"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned notes and their chunks as continuous paragraphs."""
    return scans.repaired(table(spark, d, "notes"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All near-duplicate pairs of notes and of chunks."""
    return neardup.near_duplicate_pairs(_texts(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class and group of every note and chunk."""
    return neardup.near_duplicate_groups(_texts(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of nodes that stand for the same person or organisation."""
    return names.variant_pairs(names.entities(table(spark, d, "nodes"), table(spark, d, "name_forms")))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity of every person and organisation among the nodes."""
    return names.entities(table(spark, d, "nodes"), table(spark, d, "name_forms"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_column(table(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """The window of every document, or of its pieces, for each capacity."""
    sizes = cut(tokens.count_tokens(table(spark, d, "documents")), "p7-sizes")
    return packing.pack(sizes, table(spark, d, "pack_windows"))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """Windows, documents and the share of room used for each capacity."""
    return packing.usage(p7_packing(spark, d), table(spark, d, "pack_windows"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document with prose."""
    return p8_levels(spark, d).where("level IS NOT NULL").select("doc_id", "level")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Words of prose, score and level of every document."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "graded_passages"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words per source and level."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(p8_levels(spark, d), "doc_id").groupBy("source", "level").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_clusters": p2_clusters, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_entities": p5_entities, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_usage": p7_usage, "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile}
#: All pairs of texts that share a run of three words, in SQL.
_P4 = r"""
WITH src AS (SELECT DISTINCT 'notes' AS tbl, id AS k, raw_content AS x FROM notes WHERE id IS NOT NULL UNION SELECT 'chunks', id, text FROM chunks WHERE id IS NOT NULL),
words AS (SELECT tbl, k, row_number() OVER () AS d, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM src WHERE x IS NOT NULL),
runs AS (SELECT DISTINCT tbl, k, d, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM words),
sizes AS (SELECT d, count(*) AS n FROM runs GROUP BY d),
kept AS (SELECT r.*, n FROM runs r JOIN sizes USING (d) WHERE n >= 20),
common AS (SELECT a.tbl, a.k AS ka, b.k AS kb, a.d AS da, b.d AS db, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM kept a JOIN kept b ON a.tbl = b.tbl AND a.r = b.r AND a.d < b.d AND a.k <> b.k GROUP BY a.tbl, a.k, b.k, a.d, b.d)
SELECT DISTINCT tbl, least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM common WHERE c >= 0.6 * (na + nb - c)"""
ORACLE: dict[str, str] = {"p4_found": _P4}
