"""Grouping records into similarity clusters (problem 2).

Reciprocal-nearest-neighbour average linkage on a sparse graph.  Cross-polytope hashing brings similar clusters (at first:
single vectors) into the same buckets, where links are found; then, round by round, all clusters that are each other's best
neighbour merge at once.  The similarity of two clusters is the mean over all pairs of their members, linked or not: it is
the product of the sums of their vectors, divided by their sizes.  When no link is left, the clusters are hashed anew with
other rotations, until such a pass finds no pair that reaches the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.pairs import pairs_within
from quillgraph.session import cut, drop_cut, lookup

DIMENSIONS = 64
#: Clusters merge while the mean similarity of their members reaches this.
THRESHOLD = 0.74
#: Rows of a bucket on average.
BUCKET = 32
#: Two vectors of one cluster, whose similarity is at least SURE, share no bucket in PASSES passes with at most this
#: probability; there are at least so many passes.
SURE, MISS, PASSES = 0.78, 1e-3, 2
#: Rows of a bucket that are compared at once, and links that are handed on at once.
PART, LINKS = 512, 1 << 18
#: Buckets of more rows are divided among tasks; each two parts of such a bucket meet in one task.
HOT = 16 * PART


def readable_vectors(nodes: DataFrame, id_col: str = "id", blob_col: str = "embedding_blob") -> DataFrame:
    """``(id, v)``: unit vectors of the rows whose blob holds exactly 64 finite numbers that are not all 0.

    Numbers of 4 or 8 bytes, little-endian, any length (norm).  Of repeated rows of an id, the earliest readable one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, blob in enumerate(batch.column(1).to_pylist()):
                if len(blob) == 4 * DIMENSIONS:
                    v = np.frombuffer(blob, "<f4").astype(float)
                else:
                    v = np.frombuffer(blob, "<f8")
                if np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()
                    keep.append(i)
                    rows.append(v / np.linalg.norm(v))
            flat = np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * DIMENSIONS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64())), vectors], names=["id", "at", "v"])

    rows = nodes.where(F.col(id_col).isNotNull() & F.length(blob_col).isin(4 * DIMENSIONS, 8 * DIMENSIONS)).select(F.col(id_col).cast("string").alias("id"), blob_col, F.coalesce(F.col("ingested_at").cast("string"), F.lit("~")).alias("at"))
    return rows.mapInArrow(run, "id string, at string, v array<float>").groupBy("id").agg(F.min_by("v", F.struct("at", "v")).alias("v"))


def _axes(n: int) -> list[int]:
    """Axes of each rotation for so many rows, so that a bucket has BUCKET rows on average whatever their number; the first
    rotation has all axes, the last as many as are needed."""
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET))) - 1 - int(math.log2(DIMENSIONS)))
    axes = [DIMENSIONS]
    while bits > 0:
        step = min(bits, 1 + int(math.log2(DIMENSIONS)))
        axes.append(1 << (step - 1))
        bits -= step
    return axes


@lru_cache
def _meeting(cosine: float, axes: int, draws: int = 100_000) -> float:
    """The probability that two vectors of this similarity have the same nearest of so many axes, by simulation."""
    rng = np.random.default_rng(13)
    x, z = rng.standard_normal((2, draws, DIMENSIONS), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1, keepdims=True)
    i, j = np.abs(x[:, :axes]).argmax(axis=1), np.abs(y[:, :axes]).argmax(axis=1)
    every = np.arange(draws)
    return float(((i == j) & ((x[every, i] > 0) == (y[every, j] > 0))).mean())


def tables_for(n: int, miss: float = MISS ** (1 / PASSES)) -> int:
    """Hash tables that so many rows need for the bound on missed pairs: narrower buckets need more of them."""
    meet = math.prod(_meeting(SURE, a) for a in _axes(n))
    return math.ceil(math.log(miss) / math.log1p(-meet))


def bucket_keys(points: DataFrame, n: int, turn: int = 0) -> DataFrame:
    """``(id, v, keys)`` of points ``(id, n, v)``: the mean vector in half precision, and the bucket in each table.

    A bucket is the nearest axis of a random rotation, and of further ones as the number of rows asks for.
    """
    tables, axes = tables_for(n), _axes(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = []
        for t in range(tables):
            rng = np.random.default_rng((11, turn, t))
            turns.append([np.linalg.qr(rng.standard_normal((DIMENSIONS, DIMENSIONS)))[0][:, :a].astype(np.float32) for a in axes])
        for batch in batches:
            x = _matrix(batch.column(2)) / np.asarray(batch.column(1), np.float32)[:, None]
            keys = np.empty((len(x), tables), np.int64)
            every = np.arange(len(x))
            for t, rotations in enumerate(turns):
                h = np.full(len(x), t + 1, np.int64)
                for rotation in rotations:
                    y = x @ rotation
                    at = np.abs(y).argmax(axis=1)
                    h = h * (2 * DIMENSIONS) + at * 2 + (y[every, at] > 0)
                keys[:, t] = h
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), lists], names=["id", "v", "keys"])

    return points.select("id", "n", "v").mapInArrow(run, "id string, v binary, keys array<bigint>")


def _matrix(column: pa.Array, kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, DIMENSIONS).astype(np.float32)


def similarity_graph(points: DataFrame, n: int, turn: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, s)``, ``a < b``: links of points ``(id, n, v)`` that share a bucket, each once; ``s`` is their mean similarity.

    All pairs of a bucket are compared, and all that reach the threshold are links, whatever the size of the bucket.
    """
    keyed = cut(bucket_keys(points, n, turn), "p2-keys")
    rows = keyed.select("id", "v", F.explode("keys").alias("bucket"))
    hot = rows.groupBy("bucket").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    placed = rows.join(lookup(hot, label="p2-hot"), "bucket", "left").select("bucket", "id", "v", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("own"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("own", q).alias("p"), F.greatest("own", q).alias("q"), (q < F.col("own")).alias("right")))
    parted = placed.select("bucket", F.explode(meets).alias("m"), "id", "v").select("bucket", "m.p", "m.q", "m.right", "id", "v")

    def blocks(s: int, e: int, right: np.ndarray, within: bool) -> Iterator[tuple[int, int, int, int]]:
        """Ranges of rows that meet: within a part, or the rows of one part with those of another."""
        half = e if within else s + int(np.count_nonzero(~right[s:e]))
        for i in range(s, half, PART):
            for j in range(i if within else half, e, PART):
                yield i, min(i + PART, half), j, min(j + PART, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """The links of the whole groups at the beginning, then the rows of the last group, which may go on."""
            b, p, q, right = (np.asarray(table.column(c)) for c in range(4))
            starts = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
            ends = np.append(starts[1:], len(b))
            rest = len(b)
            if not last:
                rest = starts[-1]
                starts, ends = starts[:-1], ends[:-1]
            ids = table.column(4).combine_chunks()
            x = _matrix(table.column(5).combine_chunks(), "<f2") if rest else None
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def made() -> pa.RecordBatch:
                i, j, sim = (np.concatenate(k) for k in zip(*found))
                found.clear()
                return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sim.astype(np.float64))], names=["a", "b", "s"])

            held = 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s < 2:
                    continue
                for i0, i1, j0, j1 in blocks(s, e, right, p[s] == q[s]):
                    sims = x[i0:i1] @ x[j0:j1].T
                    i, j = np.nonzero(sims >= threshold)
                    if i0 == j0:
                        upper = i < j
                        i, j = i[upper], j[upper]
                    if len(i):
                        found.append((i + i0, j + j0, sims[i, j]))
                        held += len(i)
                    if held > LINKS:
                        yield made()
                        held = 0
            if found:
                yield made()
            if not last:
                yield table.slice(rest)

        held: list[pa.RecordBatch] = []
        size = more = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= more:  # a group that goes on is looked at again when it has doubled
                    for out in compared(pa.Table.from_batches(held), False):
                        if isinstance(out, pa.Table):
                            held, size, more = out.to_batches(), out.num_rows, 2 * out.num_rows
                        else:
                            yield out
        if held:
            yield from compared(pa.Table.from_batches(held), True)

    links = parted.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "right").mapInArrow(run, "a string, b string, s double")
    return links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))


def _mean_similarity(links: DataFrame, points: DataFrame) -> DataFrame:
    """``(a, b, s)`` of links ``(a, b)``: the mean similarity over all pairs of members of the two clusters."""
    side = lambda c: points.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("v").alias(f"v{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(2)).astype(float) * np.asarray(batch.column(3))
            dot = np.einsum("ij,ij->i", _matrix(batch.column(4)).astype(float), _matrix(batch.column(5)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dot / size)], names=["a", "b", "s"])

    return links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a string, b string, s double")


def _added(points: DataFrame, merges: DataFrame) -> DataFrame:
    """Points after merges ``(child, parent)``: sizes and sums of vectors are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2)).copy()
            more = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            if len(more):
                x[more] += _matrix(batch.column(3).take(pa.array(more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "n", "v"])

    children = points.select(F.col("id").alias("child"), F.col("n").alias("m"), F.col("v").alias("w")).join(merges, "child").select(F.col("parent").alias("id"), "m", "w")
    kept = points.join(merges.select(F.col("child").alias("id")), "id", "left_anti").join(children, "id", "left")
    return kept.select("id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), "v", "w").mapInArrow(run, "id string, n bigint, v binary")


def reciprocal_merge(points: DataFrame, graph: DataFrame, threshold: float = THRESHOLD, max_rounds: int = 200) -> tuple[DataFrame, list[DataFrame]]:
    """The points ``(id, n, v)`` after all merges along the graph's links, and the merges ``(child, parent)`` of each round."""
    links, start = cut(graph, "p2-links"), points
    rounds: list[DataFrame] = []
    for _ in range(max_rounds):
        # one order of all links, in which equals are mixed, so that every round has mutual pairs
        rank = F.struct("s", F.xxhash64("a", "b").alias("mix"))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), rank.alias("rank")).select("e.x", "e.y", "rank")
        best = ends.groupBy("x").agg(F.max(F.struct("rank", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
        merges = cut(best.groupBy(F.greatest("x", "y").alias("child"), F.least("x", "y").alias("parent")).agg(F.count("*").alias("k")).where("k = 2").select("child", "parent"), "p2-merges")
        if merges.isEmpty():
            break
        rounds.append(merges)
        fresh = cut(_added(points, merges), "p2-points")
        now = merges.select("child", "parent").unionByName(merges.select(F.col("parent").alias("child"), "parent"))
        moved = links.join(now.select(F.col("child").alias("a"), F.col("parent").alias("pa")), "a", "left").join(now.select(F.col("child").alias("b"), F.col("parent").alias("pb")), "b", "left")
        same = moved.where("pa IS NULL AND pb IS NULL").select("a", "b", "s")
        moved = moved.where("pa IS NOT NULL OR pb IS NOT NULL").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # a pair below the threshold only comes back by a link that reaches it, which is here in its own right
        later = cut(same.unionByName(_mean_similarity(moved, fresh)).where(F.col("s") >= threshold), "p2-links")
        drop_cut(links)
        if points is not start:
            drop_cut(points)
        links, points = later, fresh
    else:
        raise RuntimeError("clusters did not settle")
    drop_cut(links)
    return points, rounds


def cluster(nodes: DataFrame, threshold: float = THRESHOLD, max_passes: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(id, v)`` of the readable nodes, and ``(id, cluster)`` of each; a cluster is named by its smallest id.

    Rows with null ids or unreadable vectors are in no cluster; a node without similar ones is a cluster of its own;
    equal vectors merge like any others; an empty table gives empty results.
    """
    vectors = cut(readable_vectors(nodes), "p2-vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(1))
            x = (np.asarray(batch.column(2).flatten()).reshape(-1, DIMENSIONS) * n[:, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "n", "v"])

    # equal vectors are the most similar ones, so they merge first, and a vector with many copies has no link for each two
    first = vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    points = cut(first.select("id", "n", "v").mapInArrow(packed, "id string, n bigint, v binary"), "p2-points")
    copies = cut(vectors.join(first.where("n > 1").select("v", F.col("id").alias("parent")), "v").where("id <> parent").select(F.col("id").alias("child"), "parent"), "p2-merges")
    rounds: list[DataFrame] = [] if copies.isEmpty() else [copies]
    for turn in range(max_passes):
        points, more = reciprocal_merge(points, similarity_graph(points, points.count(), turn, threshold), threshold)
        rounds += more
        if not more and turn + 1 >= PASSES:
            break
    else:
        raise RuntimeError("clusters did not settle")
    if not rounds:
        return vectors, vectors.select("id", F.col("id").alias("cluster"))
    # a child is in one merge, and its parent may be the child of a later one: the ways up are halved in every step
    roots = cut(reduce(DataFrame.unionByName, rounds), "p2-roots")
    for _ in range(math.ceil(math.log2(len(rounds) + 1))):
        up = roots.select(F.col("child").alias("parent"), F.col("parent").alias("root"))
        older, roots = roots, cut(roots.join(up, "parent", "left").select("child", F.coalesce("root", "parent").alias("parent")), "p2-roots")
        drop_cut(older)
    return vectors, vectors.select("id").join(roots.select(F.col("child").alias("id"), F.col("parent").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def cluster_pairs(labels: DataFrame) -> DataFrame:
    """``(node_a, node_b)``: all pairs within a cluster; large clusters are joined in blocks."""
    return pairs_within(labels, ["cluster"], "id").select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def describe(vectors: DataFrame, labels: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster, size, cohesion, typical)``: each cluster's size, the mean similarity of its pairs (1 for single
    nodes), and its most typical members: those with the highest mean similarity to the others, best first."""
    rows = vectors.join(labels, "id")
    sums = rows.groupBy("cluster").agg(F.count("*").alias("size"), vector_to_array(Summarizer.sum(array_to_vector(F.col("v").cast("array<double>")))).alias("sum"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0).cast("double"), lambda s, p: s + p)
    sums = sums.withColumn("cohesion", F.when(F.col("size") > 1, F.round((dot("sum", "sum") - F.col("size")) / (F.col("size") * (F.col("size") - 1)), 4)).otherwise(1.0))
    placed = rows.join(sums, "cluster").select("cluster", "size", "cohesion", "id", dot(F.col("v").cast("array<double>"), F.col("sum")).alias("fit"))
    top = placed.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("fit"), "id"))).where(F.col("k") <= typical)
    return top.groupBy("cluster", "size", "cohesion").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("typical"))
