"""Near-duplicate records with small edits (problem 4).

A text is the set of its runs of three words.  ProbMinHash draws the arrivals of a Poisson process per element, smallest
first, and stops an element as soon as its next arrival is later than all arrivals kept; with equal weights the share of
equal components estimates the Jaccard similarity.  Bands of components give candidate pairs, which are then verified on
the sets themselves.  Equal texts are one class from the start, so copies cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.components import connected_components
from quillgraph.operators.pairs import pairs_within
from quillgraph.session import cut

#: Bands, components of a band, and bands that a candidate pair has in common.  A pair at a similarity of 0.6 is missed
#: with a probability of 0.0015, at 0.65 of 5e-5, at 0.7 of 4e-7; one at 0.05 is a candidate with 1e-7.
BANDS, ROWS, COMMON_BANDS = 64, 4, 2
LEAST_SHINGLES, THRESHOLD, WORDS = 20, 0.6, 3
#: Up to so many keys are sent to all executors for a lookup; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEPT_WORDS = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Hashes()
_FIND = re.compile(r"[^\W_]+").findall


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different runs of ``words`` words of a text as sorted 64-bit hashes."""
    found = _FIND(text.lower()) if text else []
    if len(found) < words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = len(codes) - words + 1
    out = codes[:n].copy()
    for k in range(1, words):
        out = mix(out) + codes[k : k + n]
    return np.unique(mix(out))


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    value = xxhash.xxh3_64_intdigest(own.tobytes())
    return value - (1 << 64) if value >> 63 else value


def prob_min_hash(sets: list[np.ndarray], size: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """One row of ``size`` components per set: the element whose arrival is the first in that component.

    All sets advance together: round i draws the i-th arrival of every element that is still in the race.  An element
    leaves when its time is past the latest first arrival of its set.
    """
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    weight = np.concatenate(weights).astype(float) if weights else None
    owner = np.repeat(np.arange(len(sets)), counts)
    first = np.full(len(sets) * size, np.inf)
    signature = np.zeros(len(sets) * size, np.uint64)
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = mix(element ^ mix(np.array([turn], np.uint64)))
        step = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + (step if weight is None else step / weight)
        slot = owner * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        early = np.flatnonzero(time < first[slot])
        if len(early):
            at, t = slot[early], time[early]
            np.minimum.at(first, at, t)
            won = first[at] == t
            signature[at[won]] = element[early[won]]
        latest = first.reshape(len(sets), size).max(axis=1)
        on = time <= latest[owner]
        element, owner, time = element[on], owner[on], time[on]
        if weight is not None:
            weight = weight[on]
    return signature.reshape(len(sets), size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1)) * _M2
    for k in range(rows):
        keys = mix(keys) + parts[:, :, k]
    return mix(keys)


def _signed(texts: list[str | None], seen: set[int], bands: int, rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of shingles, fingerprint, band keys on end and number of band keys of each text."""
    if len(_WORDS) > _KEPT_WORDS:
        _WORDS.clear()
    sets = [shingles(t) for t in texts]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    prints = np.fromiter(map(fingerprint, sets), np.int64, len(sets))
    fresh = []
    for i, p in enumerate(prints.tolist()):
        if n[i] >= least and p not in seen:  # the map side's part in collapsing copies
            seen.add(p)
            fresh.append(i)
    keys = band_keys(prob_min_hash([sets[i] for i in fresh], bands * rows), bands, rows).astype(np.int64) if fresh else np.zeros((0, bands), np.int64)
    counts = np.zeros(len(texts), np.int64)
    counts[fresh] = bands
    return n, prints, keys.ravel(), counts


def signatures(df: DataFrame, tbl: str, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, least: int = LEAST_SHINGLES) -> DataFrame:
    """``(tbl, key, n, fp, bands)`` per row: the text's number of shingles, the fingerprint of its set, and its band keys
    (only at the fingerprint's first occurrence in a task, and from ``least`` shingles on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, prints, keys, counts = _signed(part.column(1).to_pylist(), seen, bands, rows, least)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(prints), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], names=["key", "n", "fp", "bands"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "key string, n bigint, fp bigint, bands array<bigint>").select(F.lit(tbl).alias("tbl"), "key", "n", "fp", "bands")


def sets_of(df: DataFrame) -> DataFrame:
    """``(tbl, fp, shingles)`` of rows ``(tbl, fp, text)`` whose text's set has the fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingles(t) for t in batch.column(2).to_pylist()]
            wanted = batch.column(1).to_pylist()
            own = [i for i, s in enumerate(every) if fingerprint(s) == wanted[i]]
            sets = [every[i].astype(np.int64) for i in own]
            part = batch.take(pa.array(own, pa.int64()))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["tbl", "fp", "shingles"])

    return df.select("tbl", "fp", "text").mapInArrow(run, "tbl string, fp bigint, shingles array<bigint>")


def class_links(signed: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(tbl, fp_a, fp_b, similarity)``: verified links between classes of equal texts.

    ``signed`` is a cut table of :func:`signatures`, ``texts`` is ``(tbl, key, text)``.
    """
    keyed = signed.select("tbl", "fp", F.explode("bands").alias("band"))
    by = Window.partitionBy("tbl", "band")
    shared = keyed.withColumn("lo", F.min("fp").over(by)).withColumn("hi", F.max("fp").over(by)).where("lo <> hi").select("tbl", "band", "fp").dropDuplicates(["tbl", "band", "fp"])
    shared = cut(shared, "p4-bands")
    # hot bands (a text in very many edits) are joined in blocks
    met = pairs_within(shared, ["tbl", "band"], "fp").select("tbl", F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    pairs = cut(met.groupBy("tbl", "fp_a", "fp_b").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON_BANDS).drop("c"), "p4-pairs")
    wanted = pairs.select("tbl", F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct()
    sources = cut(signed.join(wanted, ["tbl", "fp"], "left_semi").groupBy("tbl", "fp").agg(F.min("key").alias("key")), "p4-sources")
    lookup = F.broadcast(sources) if sources.count() <= BROADCAST_KEYS else sources
    # a key may have several rows with other texts: the row whose set has the fingerprint is the one meant
    found = sets_of(texts.join(lookup, ["tbl", "key"]).select("tbl", "fp", "text"))
    checked = found.where(F.size("shingles") >= LEAST_SHINGLES)
    sets = cut(checked.groupBy("tbl", "fp").agg(F.max("shingles").alias("shingles")), "p4-sets")
    both = pairs.join(sets.select("tbl", F.col("fp").alias("fp_a"), F.col("shingles").alias("sa")), ["tbl", "fp_a"]).join(sets.select("tbl", F.col("fp").alias("fp_b"), F.col("shingles").alias("sb")), ["tbl", "fp_b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("tbl", "fp_a", "fp_b", (F.size("sa") + F.size("sb")).alias("total"), common.alias("common")).withColumn("similarity", F.col("common") / (F.col("total") - F.col("common"))).where(F.col("similarity") >= threshold).select("tbl", "fp_a", "fp_b", "similarity")


def _prepared(tables: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    signed = cut(reduce(DataFrame.unionByName, [signatures(df, t, i, x) for t, (df, i, x) in tables.items()]), "p4-signed")
    texts = reduce(DataFrame.unionByName, [df.where(F.col(i).isNotNull()).select(F.lit(t).alias("tbl"), F.col(i).cast("string").alias("key"), F.col(x).alias("text")) for t, (df, i, x) in tables.items()])
    return signed, texts


def near_duplicate_pairs(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``(tbl, key_a, key_b)``: all pairs of records of a table whose texts are near-duplicates, smaller key first.

    ``tables`` maps a table's name to its frame, key column and text column.  Repeated rows of a key count once; texts of
    fewer than 20 shingles, null and empty texts are in no pair; null keys are left out; empty tables give no rows.
    """
    signed, texts = _prepared(tables)
    links = class_links(signed, texts, threshold).select("tbl", "fp_a", "fp_b")
    members = signed.where(F.col("n") >= LEAST_SHINGLES).select("tbl", "key", "fp").distinct()
    ma, mb = members.select("tbl", F.col("key").alias("a"), F.col("fp").alias("fp_a")), members.select("tbl", F.col("key").alias("b"), F.col("fp").alias("fp_b"))
    across = links.join(ma, ["tbl", "fp_a"]).join(mb, ["tbl", "fp_b"]).select("tbl", "a", "b").where("a <> b")
    copies = members.groupBy("tbl", "fp").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    same = pairs_within(members.join(copies, ["tbl", "fp"], "left_semi"), ["tbl", "fp"], "key").select("tbl", "a", "b")
    return across.unionByName(same).select("tbl", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def near_duplicate_groups(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``(tbl, key, class_id, group_id, n_links)``: one row per key.

    The class is the smallest key with an equal set, the group the smallest class that links lead to; ``n_links`` counts
    the links of the class to other classes.  Texts without shingles (null, empty, under three words) are a class of their own.
    """
    signed, texts = _prepared(tables)
    rows = signed.groupBy("tbl", "key").agg(F.max_by("fp", F.struct("n", "fp")).alias("fp"), F.max("n").alias("n"))
    links = cut(class_links(signed, texts, threshold).select("tbl", "fp_a", "fp_b"), "p4-links")
    node = lambda c: F.concat_ws("|", "tbl", F.col(c).cast("string"))
    parts = connected_components(links.select(node("fp_a").alias("a"), node("fp_b").alias("b"))).select(F.split("node", r"\|")[0].alias("tbl"), F.split("node", r"\|")[1].cast("bigint").alias("fp"), "component")
    degree = links.select("tbl", F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("tbl", "fp").agg(F.count("*").alias("n_links"))
    classes = rows.where("n > 0").groupBy("tbl", "fp").agg(F.min("key").alias("class_id")).join(parts, ["tbl", "fp"], "left").join(degree, ["tbl", "fp"], "left").withColumn("component", F.coalesce("component", node("fp")))
    groups = classes.groupBy("tbl", "component").agg(F.min("class_id").alias("group_id"))
    named = classes.join(groups, ["tbl", "component"]).select("tbl", "fp", "class_id", "group_id", "n_links")
    return rows.withColumn("fp", F.when(F.col("n") > 0, F.col("fp"))).join(named, ["tbl", "fp"], "left").select("tbl", "key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("group_id", "key").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
