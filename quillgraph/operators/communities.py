"""Communities by modularity: nodes move to the neighbouring community of highest gain, in rounds over the whole graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillgraph.session import BROADCAST_KEYS, cut, drop_cut


def weighted_pairs(view: DataFrame) -> DataFrame:
    """``(u, v, w)``, ``u < v``: parallel edges of both directions added up, without loops."""
    return view.where("source <> target").groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("weight").alias("w"))


#: Rounds end when fewer than this share of the nodes has moved.
SETTLED = 0.005
#: Edges of a list that a task weighs at once.
LISTED = 1 << 18


def move_nodes(pairs: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """``(node, community)``; communities are named by one of their nodes.  Rows with ``u = v`` are weights inside a node.

    In every round each node weighs its neighbours' communities and its own: w(node, c) - resolution * k(node) * k(c) / 2m,
    k(c) without the node itself.  Half of the nodes, chosen by a hash of node and round, may move at once, so neighbours do
    not swap places for ever.  A node's own community comes as a row of weight 0, and k(node) lies on its edges, so a round
    joins the edges with the labels once and the sums with the communities' sizes.  The labels of up to BROADCAST_KEYS nodes
    are sent to the edges instead (:func:`_move_listed`).  The result is a cut table.
    """
    ends = pairs.select(F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))).alias("e")).select("e.u", "e.v", "e.w")
    degree = cut(ends.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")), "cm-degree")
    total, n = degree.agg(F.sum("k"), F.count("*")).first()
    if not total:
        return degree.select("node", F.col("node").alias("community"))
    if n <= BROADCAST_KEYS:
        return _move_listed(pairs, degree, total, n, rounds, resolution)
    both = cut(ends.where("u <> v").join(degree.select(F.col("node").alias("u"), "k"), "u"), "cm-edges")
    labels, old = degree.select("node", F.col("node").alias("community"), "k"), degree
    for turn in range(rounds):
        size = labels.groupBy("community").agg(F.sum("k").alias("kc"))
        near = both.join(labels.select(F.col("node").alias("v"), "community"), "v").select(F.col("u").alias("node"), "community", "w", "k", F.lit(False).alias("own"))
        here = labels.select("node", "community", F.lit(0.0).alias("w"), "k", F.lit(True).alias("own"))
        to = near.unionByName(here).groupBy("node", "community").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("own").alias("own"))
        gain = to.join(size, "community").withColumn("gain", F.col("w") - resolution * F.col("k") * (F.col("kc") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total)
        best = gain.groupBy("node").agg(F.max(F.struct("gain", "community")).alias("b"), F.max(F.when(F.col("own"), F.struct("community", "gain"))).alias("stay"), F.max("k").alias("k"))
        may = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        goes = may & (F.col("b.gain") > F.col("stay.gain") + 1e-12)
        moved = best.select("node", F.when(goes, F.col("b.community")).otherwise(F.col("stay.community")).alias("community"), "k", goes.alias("goes"))
        seen = Observation()
        table = cut(moved.observe(seen, F.count_if("goes").alias("changed")), "cm")
        drop_cut(old)
        labels, old = table.drop("goes"), table
        if turn > 2 and seen.get["changed"] <= SETTLED * n:
            break
    drop_cut(both)
    return labels.select("node", "community")


def _move_listed(pairs: DataFrame, degree: DataFrame, total: float, n: int, rounds: int, resolution: float) -> DataFrame:
    """:func:`move_nodes` over lists of edges, written once; in each round they get all labels and give each node's move."""
    bits = sum(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) * (1 << turn) for turn in range(rounds))
    numbered = F.row_number().over(Window.orderBy("node")) - 1  # BROADCAST_KEYS rows at most
    codes = cut(degree.select("node", "k", numbered.alias("code"), bits.alias("bits")), "cm-codes")
    a, b = (F.broadcast(codes.select(F.col("node").alias(c), F.col("code").alias(f"c{c}"))) for c in ("u", "v"))
    coded = pairs.where("u <> v AND w IS NOT NULL").join(a, "u").join(b, "v").select(F.explode(F.array(F.struct(F.col("cu").alias("u"), F.col("cv").alias("v"), "w"), F.struct(F.col("cv").alias("u"), F.col("cu").alias("v"), "w"))).alias("e")).select("e.u", "e.v", "e.w")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(x: pa.Table) -> pa.RecordBatch:
            columns = [x.column(c).combine_chunks() for c in range(3)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["u", "v", "w"])

        held: list[pa.RecordBatch] = []
        size = more = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > max(LISTED, more):
                x = pa.Table.from_batches(held)
                rest = int(np.searchsorted(np.asarray(x.column(0)), x.column(0)[-1].as_py()))  # the last node may go on
                if rest:
                    yield row(x.slice(0, rest))
                held, size = x.slice(rest).to_batches(), x.num_rows - rest
                more = 2 * size
        if size:
            yield row(pa.Table.from_batches(held))

    lists = cut(coded.repartition("u").sortWithinPartitions("u").mapInArrow(packed, "u array<int>, v array<int>, w array<double>"), "cm-lists")
    known = codes.select("code", "k", "bits").orderBy("code").toPandas()
    k, may, labels = known["k"].to_numpy(), known["bits"].to_numpy(), np.arange(n, dtype=np.int32)
    spark = pairs.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((labels, k, np.bincount(labels, k, n), (may >> turn) & 1 == 0))

        def moves(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            labels, k, kc, may = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    u, v, w = (batch.column(c)[i].values.to_numpy() for c in range(3))
                    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                    nodes = u[first].astype(np.int64)
                    place = np.repeat(np.arange(len(nodes)), np.diff(np.append(first, len(u))))
                    both = np.concatenate((place, np.arange(len(nodes)))) * n + np.concatenate((labels[v], labels[nodes]))
                    met, at = np.unique(both, return_inverse=True)
                    x, c = met // n, met % n
                    near = np.bincount(at, np.concatenate((w, np.zeros(len(nodes)))), len(met))
                    mine = nodes[x]
                    own = labels[mine] == c
                    gain = near - resolution * k[mine] * (kc[c] - np.where(own, k[mine], 0.0)) / total
                    order = np.lexsort((c, gain, x))
                    best = order[np.append(np.flatnonzero(np.diff(x[order])), len(order) - 1)]
                    goes = may[nodes] & (gain[best] > gain[own] + 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[goes].astype(np.int32)), pa.array(c[best][goes].astype(np.int32))], names=["code", "community"])

        moved = lists.mapInArrow(moves, "code int, community int").toPandas()
        sent.unpersist()
        labels = labels.copy()
        labels[moved["code"].to_numpy()] = moved["community"].to_numpy()
        if turn > 2 and len(moved) <= SETTLED * n:
            break
    of = spark.createDataFrame(pa.table({"code": pa.array(np.arange(n, dtype=np.int32)), "to": pa.array(labels)}))
    named = codes.select("node", "code").join(F.broadcast(of), "code").join(F.broadcast(codes.select(F.col("code").alias("to"), F.col("node").alias("community"))), "to")
    found = cut(named.select("node", "community"), "cm")
    drop_cut(lists)
    return found


def detect(pairs: DataFrame, levels: int = 3, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """``(node, community)`` by moving nodes, then whole communities as nodes of a smaller graph, and so on."""
    labels = move_nodes(pairs, rounds, resolution)
    graph = pairs
    for _ in range(levels - 1):
        step = labels if graph is pairs else upper
        a, b = step.select(F.col("node").alias("u"), F.col("community").alias("cu")), step.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        graph = cut(graph.join(a, "u").join(b, "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")), "cm-graph")
        upper = move_nodes(graph, rounds, resolution)
        if upper.where("node <> community").isEmpty():
            break
        labels = cut(labels.join(upper.select(F.col("node").alias("community"), F.col("community").alias("top")), "community", "left").select("node", F.coalesce("top", "community").alias("community")), "cm-level")
    return labels


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(communities, modularity)`` of a partition."""
    a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    ends = pairs.join(a, "u").join(b, "v")
    inner = ends.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("inside"))
    strength = ends.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), "w"), F.struct(F.col("cv").alias("c"), "w"))).alias("x")).groupBy(F.col("x.c").alias("c")).agg(F.sum("x.w").alias("k"))
    m = pairs.agg(F.sum("w").alias("m"))
    rows = strength.join(inner, "c", "left").crossJoin(F.broadcast(m))  # one row
    q = F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2))
    return rows.agg(F.count("*").alias("communities"), F.round(q, 6).alias("modularity"))


def split_large(pairs: DataFrame, labels: DataFrame, least: int, rounds: int = 6) -> DataFrame:
    """``(node, community, part)``: communities of at least ``2 * least`` nodes divided once more by their inner edges."""
    big = labels.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * least).select("community")
    inside = labels.join(big, "community", "left_semi")
    a, b = inside.select(F.col("node").alias("u"), F.col("community").alias("cu")), inside.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    inner = pairs.join(a, "u").join(b, "v").where("cu = cv").select("u", "v", "w")
    parts = detect(inner, 2, rounds, resolution=2.0)
    return labels.join(parts.withColumnRenamed("community", "part"), "node", "left").select("node", "community", F.coalesce("part", "community").alias("part"))


def label_table(labels: DataFrame) -> DataFrame:
    """``(community, size, first)``: each community's size and its first three members."""
    place = F.row_number().over(Window.partitionBy("community").orderBy("node"))
    first = labels.withColumn("place", place).where("place <= 3").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]), ", ").alias("first"))
    return labels.groupBy("community").agg(F.count("*").alias("size")).join(first, "community")


def community_table(nodes: DataFrame, labels: DataFrame, parts: DataFrame) -> DataFrame:
    """``(id, level, parent_id, name, size, confidence)``: communities named by their first three members.

    ``labels``: ``(node, community)``, ``parts``: ``(node, community, part)`` of :func:`split_large`; the parts of a
    community are its children where there are several.  Without any label all of ``nodes`` are one general community.
    """
    top = label_table(labels).select(F.col("community").alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.col("first").alias("name"), "size", F.lit(0.9).alias("confidence"))
    several = parts.groupBy("community").agg(F.countDistinct("part").alias("n")).where("n > 1").select("community")
    inner = parts.join(several, "community", "left_semi")
    of = inner.select("community", "part").distinct()
    below = label_table(inner.select("node", F.col("part").alias("community"))).withColumnRenamed("community", "part").join(of, "part")
    below = below.select(F.concat(F.col("part"), F.lit("/1")).alias("id"), F.lit(1).alias("level"), F.col("community").alias("parent_id"), F.col("first").alias("name"), "size", F.lit(0.85).alias("confidence"))
    found = top.unionByName(below)
    if labels.isEmpty():
        every = nodes.select("node").distinct().agg(F.count("*").alias("size")).where("size > 0")
        return every.select(F.lit("general").alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit("General Community").alias("name"), "size", F.lit(0.9).alias("confidence"))
    return found


def with_summaries(communities: DataFrame, summaries: DataFrame) -> DataFrame:
    """Communities with summary and themes of ``summaries`` ``(community, themes, summary)`` written over theirs; name and
    confidence stay."""
    new = summaries.select(F.col("community").alias("id"), F.col("themes").alias("_t"), F.col("summary").alias("_s"))
    return communities.join(new, "id", "left").withColumn("summary", F.coalesce("_s", "summary")).withColumn("themes", F.coalesce("_t", "themes")).drop("_t", "_s")

