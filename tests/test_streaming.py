import os
import time

from pyspark.sql import functions as F

from litmine import schemas
from litmine.operators.mentions import mine_mentions
from litmine.streaming import incremental


def write(spark, folder, rows):
    spark.createDataFrame(rows, schemas.DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_equals_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write(spark, folder, [("a", "PDB code 1ABC here. And 2XYZ."), ("b", "none")])
    first = incremental.mine_stream(incremental.file_stream(spark, folder, schemas.DOCUMENTS).drop("arrived"))
    incremental.run_available(first, out, state)
    assert spark.read.parquet(out).count() == 2
    write(spark, folder, [("c", "PDB ID: 3DEF")])
    second = incremental.mine_stream(incremental.file_stream(spark, folder, schemas.DOCUMENTS).drop("arrived"))
    incremental.run_available(second, out, state)
    got = spark.read.parquet(out)
    want = mine_mentions(spark.read.schema(schemas.DOCUMENTS).parquet(folder))
    assert got.count() == want.count() == 3
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_first_arrival(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write(spark, folder, [("a", "1"), ("a", "2"), ("b", "3")])
    for _ in range(2):
        stream = incremental.file_stream(spark, folder, schemas.DOCUMENTS)
        incremental.run_first_arrivals(stream, out, state)
        write(spark, folder, [("a", "4"), ("c", "5")])
    names = sorted(r["file_name"] for r in spark.read.parquet(out).collect())
    assert names == ["a", "b", "c"]


def test_late_files_are_kept_and_late_copies_are_not(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write(spark, folder, [("a", "1")])
    stream = incremental.file_stream(spark, folder, schemas.DOCUMENTS)
    incremental.run_first_arrivals(stream, out, state)
    before = set(os.listdir(folder))
    write(spark, folder, [("a", "copy"), ("b", "late")])
    for name in set(os.listdir(folder)) - before:
        old = time.time() - 60 * 86_400
        os.utime(os.path.join(folder, name), (old, old))
    incremental.run_first_arrivals(stream, out, state)
    got = {r["file_name"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert got == {"a": "1", "b": "late"}


def timed(spark, times):
    return spark.createDataFrame([(t, "k") for t in times], "ts string, key string").withColumn("ts", F.to_timestamp("ts")).coalesce(1)


def test_open_windows_are_given_out_and_nothing_is_late(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = timed(spark, ["2020-01-01 00:10:00", "2020-01-01 00:50:00", "2020-01-01 01:10:00", "2020-01-01 03:00:00"])
    frame.write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)

    def run():
        incremental.run_windows(stream, "ts", ["key"], "1 hour", out, state)
        return {str(r["window_start"])[:13]: r["n"] for r in incremental.current_windows(spark, out, ["key"]).collect()}

    want = {"2020-01-01 00": 2, "2020-01-01 01": 1, "2020-01-01 03": 1}
    assert run() == want == run()
    timed(spark, ["2020-01-01 03:30:00", "2019-01-01 03:00:00"]).write.mode("append").parquet(folder)
    want |= {"2020-01-01 03": 2, "2019-01-01 03": 1}
    assert run() == want
    assert incremental.merge_windows(spark, out, ["key"]) == 0
    timed(spark, ["2019-01-01 03:59:59", "2020-01-01 00:00:00"]).write.mode("append").parquet(folder)
    want |= {"2020-01-01 00": 3, "2019-01-01 03": 2}
    assert run() == want
    assert incremental.merge_windows(spark, out, ["key"]) == 1 == incremental.merge_windows(spark, out, ["key"])
    assert run() == want


def test_a_repeated_batch_counts_once(spark, tmp_path):
    folder, out = (str(tmp_path / n) for n in ("in", "out"))
    frame = timed(spark, ["2020-01-01 00:10:00", "2018-01-01 00:50:00"])
    frame.write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    for attempt in range(2):  # the second run has lost its checkpoint and writes batch 0 again
        incremental.run_windows(stream, "ts", ["key"], "1 hour", out, str(tmp_path / f"state{attempt}"))
    assert [r["n"] for r in incremental.current_windows(spark, out, ["key"]).collect()] == [1, 1]
