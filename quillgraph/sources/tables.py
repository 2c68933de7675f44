"""Parquet tables of a note vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.session import steady


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return steady(spark).read.parquet(f"{sf_dir}/{name}.parquet")
