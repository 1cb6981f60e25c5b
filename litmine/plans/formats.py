"""Writers of the input formats, so that the readers can be run on data derived from the tables."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Bytes of text in one archive, about.
ARCHIVE_BYTES = 64 << 20


def text_lines(df: DataFrame, line: Column, path: str) -> str:
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def quoted_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def xml_rows(df: DataFrame, root: str, row: str, path: str) -> str:
    df.write.mode("overwrite").option("rootTag", root).option("rowTag", row).xml(path)
    return path


def archive_count(docs: DataFrame, least: int, size: int = ARCHIVE_BYTES) -> int:
    """How many archives hold about ``size`` bytes of text each, ``least`` of them at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // size))


def archives(docs: DataFrame, path: str, n: int) -> str:
    """``docs(entry_name, text)`` -> ``n`` tar.gz files below the folder; one task writes one archive at a time."""
    uri = path if "://" in path else (path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_fs, out_root = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for number, rows in batch.groupby("number"):
                name = f"{out_root}/articles.{number:04d}-{rows['first'].iloc[0]}.tar.gz"
                with out_fs.open_output_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="w|gz") as tar:
                    for entry, text in zip(rows["entry_name"], rows["text"]):
                        data = text.encode("utf-8")
                        info = tarfile.TarInfo(entry)
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
                yield pd.DataFrame({"name": [name]})

    numbered = docs.withColumn("number", F.pmod(F.xxhash64("entry_name"), F.lit(n)).cast("int"))
    placed = numbered.repartition(n, "number").withColumn("first", F.md5("entry_name"))
    placed.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return path
