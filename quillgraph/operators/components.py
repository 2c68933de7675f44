"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut, drop_cut


def _checksum(links: DataFrame) -> tuple:
    """Number of links and two sums over their hashes: equal if the links are."""
    h = lambda seed: F.sum(F.shiftright(F.xxhash64("u", "v", F.lit(seed)), 20))
    return tuple(links.agg(F.count("*"), h(1), h(2)).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``, the component being its smallest node; only nodes with an edge occur.

    Every round is an aggregation and a join on the node; the number of rounds grows with the logarithm of the size.
    Null ends and self loops are left out; an empty table gives an empty result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _checksum(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # large star: every node's larger neighbours are linked to its smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "cc-large")
        # small star: every node's smaller neighbours, and itself, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        fresh = cut(small, "cc-small")
        before, mark = mark, _checksum(fresh)
        drop_cut(links)
        drop_cut(large)
        links = fresh
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
