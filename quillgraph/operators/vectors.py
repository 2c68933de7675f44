"""Vectors: exact search of a stated query set in blocks, removal, mean similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, id_col: str, vec_col: str, names: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = np.asarray(part.column(0)).astype(np.int64)
                x = np.asarray(part.column(1).flatten(), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=list(names))

    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(vec_col).cast("array<float>")).mapInArrow(run, f"{names[0]} binary, {names[1]} binary")


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` rows of highest inner product for each query, itself left out.

    Blocks of queries meet blocks of rows; each pair of blocks is one matrix product and keeps ``k`` rows a query, so what
    is shuffled is ``k`` rows per query and block.  Equal scores are in the order of the ids.
    """
    left, right = _blocks(queries, id_col, vec_col, ("qi", "qv")), _blocks(vectors, id_col, vec_col, ("vi", "vv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, vi, vv in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, v_ids = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                q = np.frombuffer(qv, np.float32).reshape(len(q_ids), -1).astype(np.float64)
                v = np.frombuffer(vv, np.float32).reshape(len(v_ids), -1).astype(np.float64)
                scores = q @ v.T
                scores[q_ids[:, None] == v_ids] = -np.inf
                take = min(k, len(v_ids))
                order = np.argsort(v_ids, kind="stable")
                top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :take]]
                best = np.take_along_axis(scores, top, 1)
                ok = np.isfinite(best) & (best >= (-np.inf if least is None else least))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, take)[ok.ravel()]), pa.array(v_ids[top][ok]), pa.array(best[ok])], names=["query_id", "vec_id", "score"])

    found = left.crossJoin(right).select("qi", "qv", "vi", "vv").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def remove(vectors: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Vectors without those of the given ids."""
    return vectors.join(ids.select(id_col).distinct(), id_col, "left_anti")


def mean_pair_similarity(vectors: DataFrame, group: str, vec_col: str = "embedding") -> DataFrame:
    """``(group, n, mean_cosine)`` over all pairs of a group without making a pair: (|sum|² - n) / (n (n - 1)); 1 for single rows."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(group, F.transform(F.col(vec_col).cast("array<double>"), lambda x: x).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dims = rows.withColumn("norm", norm).where("norm > 0").select(group, "norm", F.posexplode("v").alias("pos", "x"))
    sums = dims.groupBy(group, "pos").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    return sums.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select(group, "n", F.when(F.col("n") > 1, F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 4)).otherwise(1.0).alias("mean_cosine"))
