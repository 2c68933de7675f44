"""Reading level of each document (problem 8).

A graph joins documents and graded passages with the words and pairs of neighbouring words they hold.  The passages'
levels are clamped; in each harmonic iteration a term takes the mean of its documents' levels and a document the weighted
mean of its terms', and the scale is set again by the passages, until the terms' levels stay as they are.  Terms are hashed
into as many nodes as the corpus has different terms, up to a bound, so what is sent to all executors has a bounded size;
documents' scores never leave their partition, and tasks' sums of terms are added up in a tree.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

#: Nodes for terms: 2 ** bits, by the number of different terms, within these bounds.  Slices in which sums of terms are
#: added up, and sums that one task adds.
LEAST_BITS, MOST_BITS, SLICES, FAN = 18, 22, 16, 64
#: Iterations end when the terms' levels change by less than this on average, weighed by their documents.
RESIDUAL, MOST_ITERATIONS = 0.05, 12
LEAST_WORDS = 60
#: Graded passages are a bounded, hand-made table; more than this many are refused.
MOST_GRADED = 200_000
LEVELS = 5
GRID = [0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 5.5]

_WORD = re.compile(r"[^\W\d_]+").findall
_FRONT = re.compile(r"\s*---\n.*?\n---\s*(?:\n|$)", re.S)
_OTHER = re.compile(
    r"^(?:#.*|---+|```.*|\s*[-*]?\s*\[\[.*|\s*\d{4}-\d\d-\d\d[T ]\d\d:.*|[ \t]*(?:def|class|import|from|return|for|if|while)\b.*[:(].*"
    r"|[ \t]*[\w.]+(?:\[[^\]]*\])?\s*=\s.*|\s*(?:[-*]\s*)?https?://\S+\s*|(?i:todo|fixme)\b.*|(?:from|to|cc|subject|date|title|tags):.*)$",
    re.M,
).sub
#: Inline references: addresses, code, links, numbers in brackets, and words joined by a sign; no alternative goes back over
#: what it has read, so long runs without a space take linear time.
_NOISE = re.compile(
    r"https?://\S++|`[^`\n]*+`|\[\[[^\[\]\n]*+\]\]|\[\d++\]"
    r"|(?<!\S)[^\s@_./]*+(?:(?:(?<!\w)[@_./]|[@_./](?!\w))[^\s@_./]*+)*+[@_./]\w\S*+"
).sub
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_CODES = _Hashes()


def prose(text: str | None) -> str:
    """The running prose of a text: without front matter, headings, code, logs, link lists and inline references."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    front = _FRONT.match(text)
    if front:
        text = text[front.end() :]
    return _NOISE(" ", _OTHER("", text))


def terms(text: str | None) -> tuple[np.ndarray, int]:
    """The different term nodes (of MOST_BITS bits) of a text's prose, and its number of words."""
    words = _WORD(prose(text).lower())
    if not words:
        return np.zeros(0, np.int32), 0
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    every = np.concatenate((codes * _B, codes[:-1] * _A + codes[1:] * _B))
    every = (every ^ (every >> np.uint64(29))) * _A
    return np.unique((every >> np.uint64(64 - MOST_BITS)).astype(np.int32)), len(words)


def _sliced(sums: np.ndarray, counts: np.ndarray, bits: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Nodes that occur, their sums and their counts, in SLICES parts."""
    out: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
    size = (1 << bits) // SLICES
    for k in range(SLICES):
        own = slice(k * size, (k + 1) * size)
        at = np.flatnonzero(counts[own])
        for held, values in zip(out, (at.astype("<i4"), sums[own][at].astype("<f4"), counts[own][at].astype("<f4"))):
            held.append(values.tobytes())
    return out


def term_rows(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``(kind, id, n_words, lang, level, terms, at, counts)`` of documents (kind 0) and passages (1); rows of kind 2 hold a
    task's document counts of a slice of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << MOST_BITS, np.int64)
        total = 0
        for batch in batches:
            if len(_CODES) > 2_000_000:
                _CODES.clear()
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                found = [terms(t) for t in part.column(4).to_pylist()]
                sizes = np.fromiter((len(t) for t, _ in found), np.int64, len(found))
                flat = np.concatenate([t for t, _ in found]) if len(found) else np.zeros(0, np.int32)
                count += np.bincount(flat, minlength=1 << MOST_BITS)
                total += len(found)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
                none = pa.nulls(len(found), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for _, n in found], pa.int64()), part.column(2), part.column(3), lists, none, none], names=_NAMES)
        if total:
            nodes, _, counts = _sliced(count, count, MOST_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([2] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int64()), pa.array([total] * SLICES, pa.int64()), pa.nulls(SLICES, pa.string()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.list_(pa.int32())), pa.array(nodes, pa.binary()), pa.array(counts, pa.binary())], names=_NAMES
            )

    rows = documents.where("doc_id IS NOT NULL").select(F.lit(0).alias("kind"), F.col("doc_id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("level"), "text")
    graded = passages.where(F.col("level").between(1, LEVELS) & F.col("text").isNotNull()).select(F.lit(1).alias("kind"), F.col("passage_id").cast("bigint").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("level").cast("int").alias("level"), "text")
    return rows.unionByName(graded).mapInArrow(run, "kind int, id bigint, n_words bigint, lang string, level int, terms array<int>, at binary, counts binary")


_NAMES = ["kind", "id", "n_words", "lang", "level", "terms", "at", "counts"]


class Model:
    """What a pass over the documents needs: terms' weights, levels and languages, and the scale of each language."""

    def __init__(self, bits: int, weight: np.ndarray, language: np.ndarray, level: np.ndarray, known: np.ndarray) -> None:
        self.bits, self.weight, self.level, self.known = bits, weight, level, known
        # a row of languages for each of the passages' nodes, the first row for all others
        own = np.flatnonzero(language.any(axis=0))
        self.row = np.zeros(language.shape[1], np.int32)
        self.row[own] = np.arange(1, len(own) + 1)
        self.language = np.concatenate((np.zeros((len(language), 1), np.float32), language[:, own]), axis=1)
        self.scale: list[np.ndarray] | None = None

    def free(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's mean level over its known terms (not yet on the scale of levels), the weight behind it, and its language."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        w = self.weight[flat] * self.known[flat]
        total = np.bincount(owner, w, minlength=len(sizes))
        mean = np.bincount(owner, w * self.level[flat], minlength=len(sizes)) / np.maximum(total, 1e-12)
        share = np.stack([np.bincount(owner, self.weight[flat] * lang[self.row[flat]], minlength=len(sizes)) for lang in self.language])
        return mean, total, share.argmax(axis=0)

    def levels(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's level as a number from 1 to 5, and the weight behind it."""
        mean, total, lang = self.free(flat, sizes)
        out = np.empty(len(sizes))
        for k, points in enumerate(self.scale):
            mine = lang == k
            # straight lines through the passages' mean at each level, going on beyond the ends by half a level
            out[mine] = np.interp(mean[mine], points, GRID)
        return out, total


def _arrays(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))


def _scales(rows: list, languages: list[str]) -> list[np.ndarray]:
    """Seven points per language: the passages' means at the five levels, and one on either side."""

    def points(pick: list) -> np.ndarray | None:
        means = [np.mean([r[2] for r in pick if r[1] == level]) if any(r[1] == level for r in pick) else np.nan for level in range(1, LEVELS + 1)]
        known = [i for i, m in enumerate(means) if m == m]
        if len(known) < 2:
            return None
        means = np.interp(range(LEVELS), known, [means[i] for i in known])
        means = np.maximum.accumulate(means) + np.arange(LEVELS) * 1e-9
        return means

    overall = points(rows)
    if overall is None:
        overall = np.arange(1.0, LEVELS + 1)
    out = []
    for lang in languages:
        own = [r for r in rows if r[0] == lang]
        full = {r[1] for r in own} >= set(range(1, LEVELS + 1))
        m = points(own) if full else overall
        out.append(np.concatenate(([m[0] - (m[1] - m[0]) / 2], m, [m[-1] + (m[-1] - m[-2]) / 2])))
    return out


def reading_levels(documents: DataFrame, passages: DataFrame, residual: float = RESIDUAL) -> DataFrame:
    """``(doc_id, n_words, score, level)``: one row per document.

    ``n_words`` counts the words of running prose; under 60 of them ``score`` and ``level`` are null (stubs, code, logs,
    link lists, null, empty and blank texts).  A document none of whose terms is connected to a passage gets the passages'
    mean level.  Passages without text or with a level outside 1 to 5 are left out; without any passage all levels are
    null.  Repeated rows of a document give equal rows.  Only the named columns are read.
    """
    spark = documents.sparkSession
    rows = cut(term_rows(documents, passages), "p8-terms")
    graded = rows.where("kind = 1").select("lang", "level", "terms", "id").limit(MOST_GRADED + 1).collect()
    if len(graded) > MOST_GRADED:
        raise ValueError(f"more than {MOST_GRADED} graded passages")
    docs = rows.where("kind = 0")
    if not graded:
        return docs.select(F.col("id").alias("doc_id"), "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("level"))
    tasks = rows.rdd.getNumPartitions()
    _, df, n = _added(rows.where("kind = 2").select(F.col("id").alias("slice"), F.col("n_words").alias("n"), "at", F.col("counts").alias("a"), F.col("counts").alias("b")), tasks, MOST_BITS)
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.count_nonzero(df) * 2 - 1).bit_length()))
    size = 1 << bits
    df = df.reshape(size, -1).sum(axis=1)
    weight = np.where(df >= 2, np.log1p(n / np.maximum(df, 1)), 0.0)
    languages = sorted({r.lang for r in graded})
    flat = np.concatenate([np.array(r.terms, np.int64) for r in graded]) >> (MOST_BITS - bits)
    sizes = np.array([len(r.terms) for r in graded])
    held = np.repeat(np.array([r.level for r in graded], float), sizes)
    tongue = np.stack([np.bincount(flat, np.repeat([float(r.lang == x) for r in graded], sizes), minlength=size) for x in languages])
    tongue = tongue / np.maximum(tongue.sum(axis=0), 1)
    own_sum, own_count = np.bincount(flat, held, minlength=size), np.bincount(flat, minlength=size).astype(float)
    mean_level = float(np.mean([r.level for r in graded]))
    top, bottom = own_sum, own_count
    model = None
    for step in range(MOST_ITERATIONS):
        before, model = model, Model(bits, weight.astype(np.float32), tongue.astype(np.float32), (top / np.maximum(bottom, 1e-9)).astype(np.float32), (bottom > 0).astype(np.float32))
        # the scale: each passage is seen without its own part in its terms
        less_top, less_bottom = top[flat] - held, bottom[flat] - 1
        w = weight[flat] * (less_bottom > 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        free = np.bincount(owner, w * less_top / np.maximum(less_bottom, 1e-9), minlength=len(sizes)) / np.maximum(np.bincount(owner, w, minlength=len(sizes)), 1e-12)
        seen = np.bincount(owner, w, minlength=len(sizes)) > 0
        model.scale = _scales([(r.lang, r.level, f) for r, f, s in zip(graded, free, seen) if s], languages)
        if before is not None and moved(before, model, bottom) < residual:
            break
        sums, counts, _ = _added(_term_sums(docs, spark.sparkContext.broadcast(model)), tasks, bits)
        top, bottom = own_sum + sums, own_count + counts
    shared = spark.sparkContext.broadcast(model)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _arrays(batch, 2)
            scores, behind = shared.value.levels(flat >> (MOST_BITS - shared.value.bits), sizes)
            scores = np.where(behind > 0, scores, mean_level)
            few = np.asarray(batch.column(1)) < LEAST_WORDS
            level = np.clip(np.floor(scores + 0.5), 1, LEVELS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(scores, 4), mask=few), pa.array(level, mask=few)], names=["doc_id", "n_words", "score", "level"])

    return docs.select("id", "n_words", "terms").mapInArrow(last, "doc_id bigint, n_words bigint, score double, level bigint")


def moved(before: Model, after: Model, counts: np.ndarray) -> float:
    """By how much the levels of the nodes known before and after have changed, on average over their documents."""
    both = (before.known > 0) & (after.known > 0)
    w = counts * both
    return float((w * np.abs(after.level - before.level)).sum() / max(w.sum(), 1e-9)) if (after.known > before.known).sum() == 0 else float("inf")


def _term_sums(docs: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """``(slice, n, at, a, b)``: a task's sums of levels and counts of documents per term, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.bits
        sums, counts = np.zeros(1 << bits), np.zeros(1 << bits)
        for batch in batches:
            flat, sizes = _arrays(batch, 1)
            flat = flat >> (MOST_BITS - bits)
            scores, behind = shared.value.levels(flat, sizes)
            use = np.repeat((behind > 0) & (np.asarray(batch.column(0)) >= LEAST_WORDS), sizes)
            flat = flat[use]
            sums += np.bincount(flat, np.repeat(scores, sizes)[use], minlength=1 << bits)
            counts += np.bincount(flat, minlength=1 << bits)
        at, a, b = _sliced(sums, counts, bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([0] * SLICES, pa.int64()), *(pa.array(x, pa.binary()) for x in (at, a, b))], names=["slice", "n", "at", "a", "b"])

    return docs.select("n_words", "terms").mapInArrow(run, "slice bigint, n bigint, at binary, a binary, b binary")


def _added(parts: DataFrame, tasks: int, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The tasks' slices ``(slice, n, at, a, b)`` added up in a tree, FAN at a time; the result has a bounded size."""
    size = (1 << bits) // SLICES

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros(size), np.zeros(size)
        for at, x, y in zip(pdf["at"], pdf["a"], pdf["b"]):
            where = np.frombuffer(at, "<i4")
            a[where] += np.frombuffer(x, "<f4")
            b[where] += np.frombuffer(y, "<f4")
        where = np.flatnonzero(b)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "task": [pdf["task"].iloc[0]], "n": [pdf["n"].sum()], "at": [where.astype("<i4").tobytes()], "a": [a[where].astype("<f4").tobytes()], "b": [b[where].astype("<f4").tobytes()]})

    parts = parts.withColumn("task", F.spark_partition_id().cast("bigint"))
    while True:
        tasks = math.ceil(tasks / FAN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("slice", "task").applyInPandas(add, "slice bigint, task bigint, n bigint, at binary, a binary, b binary")
        if tasks <= 1:
            break
    sums, counts, n = np.zeros(1 << bits), np.zeros(1 << bits), 0
    for r in parts.collect():
        where = np.frombuffer(r["at"], "<i4") + r["slice"] * size
        sums[where] += np.frombuffer(r["a"], "<f4")
        counts[where] += np.frombuffer(r["b"], "<f4")
        n += r["n"] if r["slice"] == 0 else 0
    return sums, counts, n
