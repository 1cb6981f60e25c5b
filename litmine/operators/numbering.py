"""Consecutive numbers and running sums over a total order without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.session import cut

_ROW_BITS = 33


def number_rows(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Add ``name`` = 1..n in the given order; the order should be total.

    Rows are range-partitioned and sorted, and the result is put on shared storage, because the range
    bounds are sampled and must be the same for the counts and for the rows. The table of offsets has one
    row per partition, so it is broadcast whatever the size of the data.
    """
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row + 1)
        .drop("_part", "_offset", "_at")
    )


def running_sums(df: DataFrame, *order: Column | str, **sums: Column) -> DataFrame:
    """Add for each ``name=column`` of ``sums`` the sum over all rows up to this one in the given order, which should be total.

    As ``number_rows``: one range sort, sums within each of its parts, and a table of one row per part with those before.
    """
    placed = cut(
        df.withColumns(sums).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(name).alias(name) for name in sums])
    offsets = totals.select("_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.withColumns({name: F.sum(name).over(within) for name in sums}).join(F.broadcast(offsets), "_part")
    return met.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_at", "_part", *[f"_{name}" for name in sums])
