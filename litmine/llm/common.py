"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.session import discard, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as Parquet on the shared scratch folder: cuts the lineage, and later reads are pruned by column. ``discard`` of
    the session module removes the files."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    for made in _open:
        made.append(found)
    return found


_open: list[list[DataFrame]] = []  # what is stored inside each call of ``alone`` that runs


def alone(make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """``make()`` as Parquet; all that was stored on the way to it is removed once it is there."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        found = stored(make(), purpose)
    finally:
        _open.pop()
    for step in made:
        if step is not found:
            discard(step)
    return found


def numbered(docs: DataFrame) -> DataFrame:
    """``(doc, row)``: every row of ``docs`` as a struct, with a key of its own, on shared storage; a key that is not stored
    may change when a task runs again."""
    return stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")


def texts(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns plus ``text`` with null as the empty text; all other columns are dropped, so that theirs
    cannot clash with columns that an operator adds."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def dealt(df: DataFrame, *keys: str, at_least: int = 1) -> DataFrame:
    """Hash-partition by ``keys`` into as many parts as the session asks for, or ``at_least`` so many; adaptive execution
    cannot merge them, so costly Python work keeps all slots busy."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, at_least), *keys)


def portions(batches: Iterator[pa.RecordBatch], size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        first, ends = 0, np.cumsum(pc.binary_length(batch.column(text)).to_numpy())
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + size)))
            yield batch.slice(first, last - first)
            first = last
