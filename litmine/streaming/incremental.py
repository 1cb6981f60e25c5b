"""Incremental mining and windowed counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from litmine.operators.mentions import mine_mentions
from litmine.operators.rules import PDB, RulePack


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                max_files: int = 1000) -> DataFrame:
    """New Parquet files of a folder, with the arrival time of their file as ``arrived``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .option("maxFileAge", "36500d")  # else a file dated a week before the newest one seen is passed over
        .parquet(folder)
        .withColumn("arrived", F.col("_metadata.file_modification_time"))
    )


def run_first_arrivals(stream: DataFrame, path: str, checkpoint: str, key: str = "file_name") -> StreamingQuery:
    """Keep the first copy of every article, however late a copy comes or whatever the time of its file.

    The names already taken are those in the sink; a batch is reduced to one copy per name (the first to arrive, then the
    smallest) and meets them in an anti join. A batch writes its own folder, so a repeated batch replaces itself.
    """
    columns = [c for c in stream.columns if c not in (key, "arrived")]
    order = [c for c in ("arrived",) if c in stream.columns] + columns
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        taken = spark.read.schema(f"{key} string, batch long").parquet(path).filter(F.col("batch") < number)
        first = batch.groupBy(key).agg(F.min(F.struct(*order)).alias("first")) if order else batch.select(key).distinct()
        first = first.select(key, "first.*") if order else first
        first.join(taken, key, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def mine_stream(stream: DataFrame, pack: RulePack = PDB, id_column: str = "pdb_id") -> DataFrame:
    """The batch operator on a stream: it is map-only and so has no state."""
    return mine_mentions(stream, pack, id_column)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all files not seen yet, append to Parquet and stop. The checkpoint remembers what was seen."""
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def windowed_counts(rows: DataFrame, time: str, keys: list[str], window: str) -> DataFrame:
    """Rows per time window and key."""
    return (
        rows.groupBy(F.window(time, window).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def run_windows(stream: DataFrame, time: str, keys: list[str], window: str, path: str, checkpoint: str) -> StreamingQuery:
    """Process all files not seen yet and add their counts per window and key to the sink.

    Counts of different batches add up, so there is no state and no watermark, and a row is counted however late it comes. A
    batch writes its own folder, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        windowed_counts(batch, time, keys, window).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))


def _written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Counts merged so far, the counts of single batches, and the last batch that is merged."""
    parts = spark.read.parquet(f"{path}/parts")
    spark.createDataFrame([], parts.drop("batch").schema).write.mode("ignore").parquet(f"{path}/merged/upto=-1")
    merged = spark.read.schema(parts.drop("batch").schema.add("upto", "long")).parquet(f"{path}/merged")
    last = merged.agg(F.max("upto")).first()[0]
    return merged, parts, -1 if last is None else last


def current_windows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The count of every window that ``run_windows`` has met, open ones too."""
    merged, parts, last = _written(spark, path)
    rows = merged.filter(F.col("upto") == last).drop("upto")
    return _sums(rows.unionByName(parts.filter(F.col("batch") > last).drop("batch")), keys)


def merge_windows(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Add up the batches into one table, so that later reads open few files; gives the last batch in it. The newest batch
    stays apart, as it is the one that a restart may write again."""
    merged, parts, last = _written(spark, path)
    upto = parts.agg(F.max("batch")).first()[0] - 1
    if upto > last:
        older = parts.filter(F.col("batch").between(last + 1, upto)).drop("batch")
        rows = merged.filter(F.col("upto") == last).drop("upto").unionByName(older)
        _sums(rows, keys).write.mode("overwrite").parquet(f"{path}/merged/upto={upto}")
    return max(upto, last)
