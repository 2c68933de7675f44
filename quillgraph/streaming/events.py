"""Windows over event streams; the same functions run on batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that land in a folder, with the schema of the files that are there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n, total)`` per window; events later than ``late`` are left out of a stream's closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events without a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeated ids within the time that a stream waits for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def conversation_memory(turns: DataFrame, keep: int = 12) -> DataFrame:
    """``(session_id, n, lines)``: a stream's sessions with their last ``keep`` turns, kept as state between batches.

    ``turns``: ``(session_id, at, line)``.  A session's state holds ``keep`` lines and its number of turns, no more.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        lines, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for part in parts:
            part = part.sort_values("at", kind="stable")
            n += len(part)
            lines = (lines + part["line"].tolist())[-keep:]
        state.update((lines, n))
        yield pd.DataFrame({"session_id": [key[0]], "n": [n], "lines": [lines]})

    return turns.groupBy("session_id").applyInPandasWithState(update, "session_id string, n bigint, lines array<string>", "lines array<string>, n bigint", "update", "NoTimeout")
