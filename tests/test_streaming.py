from datetime import datetime as dt
from datetime import timedelta

from pyspark.sql import functions as F

from quillgraph.streaming import events


def made(spark):
    rows = [(i, dt(2024, 1, 1) + timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "click", 1.5) for i in range(200)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_stream_equals_batch(spark, tmp_path):
    made(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    got = run(spark, events.tumbling(events.read_events(spark, str(tmp_path / "in"))), "w", "complete")
    want = events.tumbling(made(spark))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sessions_and_first_seen(spark, tmp_path):
    made(spark).union(made(spark)).write.parquet(str(tmp_path / "in"))
    stream = events.first_seen(events.read_events(spark, str(tmp_path / "in")))
    assert run(spark, stream, "f", "append").count() == 200
    assert events.sessions(made(spark)).agg(F.sum("n")).first()[0] == 200
    assert events.sessions(made(spark), gap="10 hours").count() == 3


def test_conversation_memory(spark, tmp_path):
    rows = [(f"s{i % 2}", dt(2024, 1, 1) + timedelta(minutes=i), f"line {i}") for i in range(40)]
    spark.createDataFrame(rows, "session_id string, at timestamp_ntz, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, at timestamp_ntz, line string").parquet(str(tmp_path / "in"))
    got = {r.session_id: (r.n, r.lines) for r in run(spark, events.conversation_memory(stream), "m", "update").collect()}
    assert got["s0"] == (20, [f"line {i}" for i in range(16, 40, 2)])
