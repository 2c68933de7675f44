"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quillgraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution); the cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}
#: Up to so many rows of keys are sent to all executors for a lookup; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def steady(spark: SparkSession) -> SparkSession:
    """Turn off the reuse of a common partitioning by unions: in Spark 4.1 such a union fails ("Can't zip RDDs with
    unequal numbers of partitions") where one side's input is a union itself.  It costs a shuffle at most."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, unless their search path has it anyway."""
    root = Path(__file__).resolve().parent.parent
    here = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in here:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-quill-")) / "quillgraph.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "quillgraph").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, but only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-quill-")
        base = f"file://{_LOCAL[app]}"
    return f"{base.rstrip('/')}/quill-{app}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, and a lost executor costs nothing: the files outlive it.
    """
    steady(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path = path  # noqa: SLF001
    return out


def lookup(df: DataFrame, most: int = BROADCAST_KEYS, label: str = "lookup") -> DataFrame:
    """``df`` as a cut table of keys, to be sent to all executors if it has ``most`` rows at most."""
    keys = cut(df, label)
    return F.broadcast(keys) if keys.count() <= most else keys


def clear_cuts(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; for use once the results built on them have been read."""
    _delete(spark, shared_dir(spark))


def drop_cut(df: DataFrame | None) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)  # noqa: SLF001
