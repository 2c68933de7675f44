import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import clusters

SCHEMA = "id string, embedding_blob binary, ingested_at timestamp_ntz, v string, cluster string"


def made(rng, n_clusters, sizes, noise=0.35):
    rows = []
    for c in range(n_clusters):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for _ in range(sizes[c % len(sizes)]):
            x = rng.standard_normal(64)
            rows.append(centre + noise * x / np.linalg.norm(x))
    return np.array(rows)


def truth(x, ids, threshold=clusters.THRESHOLD):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(s >= threshold, 1)))}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_pairs_and_description(spark):
    rng = np.random.default_rng(5)
    x = made(rng, 25, [1, 2, 3, 20, 70])
    ids = [f"n{i:04}" for i in range(len(x))]
    blobs = [np.asarray(v * (10.0 ** (i % 5)), "<f8" if i % 7 == 0 else "<f4").tobytes() for i, v in enumerate(x)]
    rows = [(i, b, None, "x", "y") for i, b in zip(ids, blobs)]
    rows += [(ids[0], blobs[0], None, "x", "y"), ("bad1", None, None, None, None), ("bad2", b"", None, None, None), ("bad3", struct.pack("<64f", *[0.0] * 64), None, None, None), ("bad4", struct.pack("<64f", *[float("nan")] * 64), None, None, None), ("bad5", blobs[1][:100], None, None, None), (None, blobs[0], None, None, None)]
    vectors, labels = clusters.cluster(frame(spark, rows))
    got = {(r.node_a, r.node_b) for r in clusters.cluster_pairs(labels).collect()}
    assert got == truth(x, ids)
    assert {r.id for r in labels.collect()} == set(ids)
    found = clusters.describe(vectors, labels).collect()
    assert sum(r["size"] for r in found) == len(ids)
    big = max(found, key=lambda r: r["size"])
    own = [ids.index(r.id) for r in labels.where(F.col("cluster") == big.cluster).collect()]
    u = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
    best = [ids[own[k]] for k in np.argsort(-(u @ u.sum(0)))[:3]]
    assert set(big.typical) == set(best)


def test_copies_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PART", 20)
    monkeypatch.setattr(clusters, "HOT", 60)
    rng = np.random.default_rng(6)
    same = made(rng, 1, [1])
    x = np.concatenate((np.repeat(same, 250, 0), made(rng, 40, [1, 2, 5])))
    ids = [f"n{i:04}" for i in range(len(x))]
    rows = [(i, np.asarray(v, "<f4").tobytes(), None, None, None) for i, v in zip(ids, x)]
    got = {(r.node_a, r.node_b) for r in clusters.cluster_pairs(clusters.cluster(frame(spark, rows))[1]).collect()}
    assert got == truth(x, ids)


def basis(rows):
    """Vectors with the given matrix of similarities."""
    values, axes = np.linalg.eigh(np.asarray(rows))
    x = axes * np.sqrt(np.maximum(values, 0))
    return np.pad(x, ((0, 0), (0, 64 - x.shape[1])))


def test_bridged_groups_stay_apart(spark):
    """Two groups of four, one pair of which is similar enough for a link: the mean over all 16 pairs is not."""
    s = np.full((8, 8), 0.55)
    s[:4, :4] = s[4:, 4:] = 0.9
    s[3, 4] = s[4, 3] = 0.75
    np.fill_diagonal(s, 1.0)
    x = basis(s)
    rows = [(f"n{i}", v.astype("<f8").tobytes(), None, None, None) for i, v in enumerate(x)]
    labels = {r.id: r.cluster for r in clusters.cluster(frame(spark, rows))[1].collect()}
    assert labels == {f"n{i}": "n0" if i < 4 else "n4" for i in range(8)}


def average_linkage(x, threshold):
    """Merge the best pair of clusters, again and again."""
    groups = [[i] for i in range(len(x))]
    sums = [x[i] for i in range(len(x))]
    while len(groups) > 1:
        m = np.array([v / len(g) for v, g in zip(sums, groups)])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        i, j = np.unravel_index(s.argmax(), s.shape)
        if s[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        sums[i] = sums[i] + sums.pop(j)
    return {frozenset(g) for g in groups}


def test_equals_sequential_average_linkage_without_a_gap(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((6, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.array([centres[i % 6] * (0.8 + 0.4 * rng.random()) + 0.55 * z / np.linalg.norm(z) for i, z in enumerate(rng.standard_normal((90, 64)))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"n{i:03}", v.astype("<f8").tobytes(), None, None, None) for i, v in enumerate(x)]
    got = {}
    for r in clusters.cluster(frame(spark, rows))[1].collect():
        got.setdefault(r.cluster, set()).add(int(r.id[1:]))
    want = average_linkage(x, clusters.THRESHOLD)
    same = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
    one, two = same(got.values()), same(want)
    assert len(one & two) >= 0.9 * len(one | two) and len(two) > 50


def test_all_links_of_a_large_bucket(spark, monkeypatch):
    """No partner is left out, neither beyond the best ones nor in another part of the bucket."""
    monkeypatch.setattr(clusters, "HOT", 300)
    rng = np.random.default_rng(8)
    x = made(rng, 1, [700], 0.2)
    rows = [(f"n{i:03}", 1, (v / np.linalg.norm(v)).astype("<f4").tobytes()) for i, v in enumerate(x)]
    graph = clusters.similarity_graph(spark.createDataFrame(rows, "id string, n bigint, v binary"), len(rows))
    assert graph.count() == 700 * 699 // 2


def test_empty(spark):
    vectors, labels = clusters.cluster(frame(spark, []))
    assert labels.count() == 0 and clusters.describe(vectors, labels).count() == 0


@pytest.mark.parametrize("n", [7_000, 73_000, 730_000, 3_000_000])
def test_clusters_of_two_meet_at_any_size(spark, n):
    """Two vectors at the least similarity of a cluster share a bucket, however narrow the buckets of ``n`` vectors are."""
    rng, count = np.random.default_rng(7), 3000
    x, z = rng.standard_normal((2, count, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = clusters.SURE * x + np.sqrt(1 - clusters.SURE**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(f"{side}{i}", 1, v.astype("<f4").tobytes()) for side, m in (("x", x), ("y", y)) for i, v in enumerate(m)]
    points = spark.createDataFrame(rows, "id string, n bigint, v binary")
    met = set()
    for turn in range(clusters.PASSES):
        buckets = clusters.bucket_keys(points, n, turn).select(F.explode("keys").alias("bucket"), F.substring("id", 1, 1).alias("side"), F.expr("substr(id, 2)").alias("pair"))
        met |= {r.pair for r in buckets.groupBy("bucket", "pair").agg(F.countDistinct("side").alias("c")).where("c = 2").select("pair").distinct().collect()}
    assert len(met) >= count * (1 - 4 * clusters.MISS)
