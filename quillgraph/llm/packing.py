"""Filling windows of fixed capacity with documents (problem 7).

First-fit decreasing with a tournament tree over the free room of the open windows.  Documents are dealt at random (by a
hash of their id) into groups of bounded size; each group of each window size is packed on its own, so no task holds more
than one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a group, about; larger groups leave less unused room and take more memory.
GROUP_SIZE = 20_000
PLACED = "window_id int, doc_id bigint, piece int, first_token bigint, n_tokens bigint, bin_id string"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, the items being in descending order of size.

    The tree's leaves are the bins' free room and each inner node the most room below it: the leftmost bin with enough
    room is found by walking down from the root.
    """
    n = len(sizes)
    width = 1 << max(0, (max(n, 1) - 1).bit_length())
    room = [capacity] * (2 * width)
    out = np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < width:
            at *= 2
            if room[at] < size:
                at += 1
        out[i] = at - width
        left = room[at] - size
        room[at] = left
        while at > 1:
            most = max(room[at], room[at ^ 1])
            at >>= 1
            if room[at] == most:
                break
            room[at] = most
    return out


def pack(sizes: DataFrame, windows: DataFrame, group_size: int = GROUP_SIZE, seed: int = 7) -> DataFrame:
    """Put every document into windows of every capacity.

    ``sizes`` is ``(doc_id, n_tokens)``, ``windows`` is ``(window_id, capacity_tokens)`` (a short list of settings that is
    read on the driver).  A document longer than the window is cut into full windows and a rest; any other stays whole.
    Returns ``(window_id, doc_id, piece, first_token, n_tokens, bin_id)``; a full piece has a bin of its own.  Documents
    without tokens (0 or null) take no room: one row, null ``bin_id``.  Null or non-positive capacities have no rows.  Repeated rows
    of a document count once.
    """
    sizes = sizes.groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).cast("bigint").alias("n"))
    total = sizes.count()
    groups = max(1, -(-total // group_size))
    settings = [(r.window_id, r.capacity_tokens) for r in windows.select("window_id", "capacity_tokens").distinct().sort("window_id", "capacity_tokens").collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if not settings:
        return sizes.sparkSession.createDataFrame([], PLACED)
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("bigint").alias("capacity")) for w, c in settings])).alias("w")
    items = sizes.select("doc_id", "n", each).select("doc_id", "n", "w.window_id", "w.capacity").withColumn("full", F.expr("n div capacity")).withColumn("rest", F.expr("n % capacity"))
    full = items.where("full > 0").select("window_id", "doc_id", "capacity", F.posexplode(F.expr("sequence(1L, full)")).alias("piece", "_k")).select(
        "window_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("bin_id")
    )
    nothing = items.where("n = 0").selectExpr("window_id", "doc_id", "0 AS piece", "0L AS first_token", "0L AS n_tokens", "CAST(NULL AS STRING) AS bin_id")
    rest = items.where("rest > 0").withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "doc_id"], ascending=[False, True], kind="stable")
        bins = first_fit_decreasing(pdf["rest"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({
            "window_id": pdf["window_id"], "doc_id": pdf["doc_id"], "piece": pdf["full"].astype("int32"), "first_token": pdf["full"] * pdf["capacity"], "n_tokens": pdf["rest"],
            "bin_id": ("g" + str(pdf["grp"].iloc[0]) + ".") + pd.Series(bins, index=pdf.index).astype(str),
        })

    packed = rest.select("window_id", "doc_id", "capacity", "full", "rest", "grp").groupBy("window_id", "capacity", "grp").applyInPandas(fill, PLACED)
    return packed.unionByName(full).unionByName(nothing)


def usage(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window size: documents, pieces, bins, tokens and the share of room that is used."""
    bins = placed.where("bin_id IS NOT NULL").groupBy("window_id", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("documents"))
    return bins.groupBy("window_id").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum("documents").alias("documents")).join(F.broadcast(windows.groupBy("window_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))), "window_id").withColumn("filled", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))
