"""Markdown folders as notes, their match with stored notes, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import body, first_heading, front_matter, stripped, tag_list
from quillgraph.operators.vault import latest


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, title, source_file, source_type, date, tags, raw_content)`` of all Markdown files below a folder.

    Files are read whole and in parallel; empty bodies are left out; bytes that are no UTF-8 become replacement signs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rows = files.select("path", name.alias("name"), stem.alias("stem"), F.decode("content", "UTF-8").alias("raw_content")).withColumn("meta", front_matter("raw_content")).where(stripped(body("raw_content")) != "")
    get = lambda k: F.try_element_at("meta", F.lit(k))
    return rows.select(
        F.regexp_replace(F.lower("stem"), " ", "_").alias("id"), F.coalesce(F.when(stripped(get("title")) != "", get("title")), first_heading(body("raw_content")), F.col("stem")).alias("title"), F.col("path").alias("source_file"),
        F.coalesce(get("source_type"), F.lit("markdown")).alias("source_type"), get("date").alias("date"), F.to_json(tag_list(get("tags"))).alias("tags"), "raw_content",
    )


def _file(column: str) -> Column:
    return F.lower(F.regexp_extract(column, r"([^/]*)$", 1))


def match_disk(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Stored notes whose file is still there, and new files' notes; notes that were removed do not come back.

    ``stored`` and ``disk`` have ``id`` and ``source_file``, ``stored`` also ``deleted_at`` and ``ingested_at``.
    """
    own = latest(stored, "source_file", "deleted_at", "ingested_at")
    there = disk.select(_file("source_file").alias("f")).distinct()
    kept = own.withColumn("f", _file("source_file")).join(there, "f", "left_semi").where("deleted_at IS NULL").select("id", "source_file", F.lit("stored").alias("origin"))
    new = disk.join(own.select("id"), "id", "left_anti").select("id", "source_file", F.lit("new").alias("origin"))
    return kept.unionByName(new)


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row over ``(status, pages, confidence)`` of many files: how many came in, failed, their pages and mean confidence."""
    ok = F.col("status") == "success"
    return results.agg(F.count("*").alias("files"), F.count_if(ok).alias("succeeded"), F.count_if(~ok | F.col("status").isNull()).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("pages"), F.round(F.avg(F.when(ok, F.col("confidence"))), 2).alias("confidence"))


def write(df: DataFrame, path: str, kind: str, **options: object) -> None:
    """Write a table as ``parquet``, ``json``, ``csv`` (with a header) or ``text`` (one string column)."""
    if kind == "csv":
        options = {"header": True, "escape": '"', **options}
    df.write.mode("overwrite").options(**options).format(kind).save(path)
