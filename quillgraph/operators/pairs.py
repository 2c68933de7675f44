"""All pairs within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import lookup

#: Groups of more rows than this are divided into blocks, which meet two by two.
BLOCK = 2048


def pairs_within(rows: DataFrame, group: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """``(*group, a, b)``, ``a < b``: every pair of different items of a group.

    A group of n rows is divided into n / block blocks, and each two blocks of it are a key of their own, so a key has at
    most two blocks' rows whatever the size of the group.  Null groups and items are in no pair; ``rows`` has each item
    of a group once.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).where("_parts > 1")
    part = F.pmod(F.xxhash64(item), F.coalesce("_parts", F.lit(1))).cast("int")
    placed = rows.join(lookup(sizes, label="hot-groups"), group, "left").select(*group, item, part.alias("_p"), F.coalesce("_parts", F.lit(1)).alias("_parts"))
    left = placed.select(*group, F.col(item).alias("a"), F.col("_p"), F.explode(F.sequence(F.col("_p"), F.col("_parts") - 1)).alias("_q"))
    right = placed.select(*group, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_p"), F.col("_p").alias("_q"))
    met = left.join(right, [*group, "_p", "_q"]).where("_p < _q OR a < b").where("a <> b")
    return met.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
