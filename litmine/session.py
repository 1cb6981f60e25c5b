"""Spark session, shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "litmine", cpus: int | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, pass your own session instead."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster without it is an
    error, because a folder of one machine is lost with the machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="litmine-")
        sc.setCheckpointDir(configured)
    return configured or current


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path for intermediate files below the shared folder."""
    return f"{checkpoint_dir(spark)}/litmine-{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give costly row work to all slots if the input comes in fewer parts, as a small file does.

    Large inputs have more parts than slots and are left as they are. For plain scans: with a shuffle in the
    plan, asking for the parts would run it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < slots else df


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffles is removed from disk as the query ends. Otherwise its files stay until the driver happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, replaces: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Store as Parquet on shared storage and read it again, so that loops stay flat and survive lost executors.

    Later uses read only the columns they need. ``replaces`` is an earlier result of this function that nothing needs
    once the new one is stored; its files are removed. ``by`` is a column with few values, each a folder of its own.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "cut")
    with shuffles_removed(spark):
        df.write.parquet(path, partitionBy=by)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    if replaces is not None:
        discard(replaces)
    return found


def cut_by(df: DataFrame, key: str, parts: int, replaces: DataFrame | None = None, codec: str = "snappy") -> DataFrame:
    """Like ``cut``, but as a table bucketed and sorted by ``key``, so that a join or an aggregate on ``key`` in as many
    parts finds the rows in place and does not shuffle them again. ``codec`` is for wide rows that are read seldom.

    The files lie in the shared folder; the session's catalog has only a name for them, which ``discard`` removes.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "buckets")
    name = os.path.basename(path).replace("-", "_")
    with shuffles_removed(spark):
        df.write.format("parquet").bucketBy(parts, key).sortBy(key).options(path=path, compression=codec).saveAsTable(name)
    found = spark.table(name)
    found._stored_at, found._named = path, name
    if replaces is not None:
        discard(replaces)
    return found


def discard(df: DataFrame) -> None:
    """Remove the files of a result of ``cut`` or ``cut_by``; any other frame is left as it is."""
    path, name = df.__dict__.pop("_stored_at", None), df.__dict__.pop("_named", None)
    if name is not None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path is not None:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def grown(pieces: list[DataFrame], limit: int = 8) -> list[DataFrame]:
    """Union the pieces of a growing set into one stored piece once there are ``limit``, so that scans stay short."""
    return pieces if len(pieces) < limit else [cut(union(pieces))]


def union(pieces: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, pieces)
