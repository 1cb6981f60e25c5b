"""Article archives: tar.gz files of texts, unpacked by the executors."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine import schemas
from litmine.functions.fields import base_name, extension
from litmine.session import cut

# One output batch holds about this many characters, whatever the size of the archive.
BATCH_CHARS = 32 << 20

# Bits of a filter of names (4 MB) and bits per name: of other names it holds one in 1,000 at 2.3 million names.
FILTER_BITS = 1 << 25
FILTER_HASHES = 7


# Hadoop's names of file systems, and those of Arrow.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def _uri(path: str) -> str:
    """A path as Spark lists it, as Arrow names it."""
    for ours, theirs in SCHEMES.items():
        if path.startswith(ours):
            return theirs + path[len(ours) :].lstrip("/")
    return path if "://" in path else path.replace("file:/", "file:///", 1)


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(_uri(path))
    # The tar reader below does the decompression.
    return fs.open_input_stream(inner, compression=None)


@dataclass(frozen=True)
class NameFilter:
    """A Bloom filter of article names: of a name that was put in it always says yes, of another one rarely. Its size is
    fixed, however many names there are; with more names it says yes more often."""

    bits: bytes
    hashes: int

    def __contains__(self, name: str) -> bool:
        mark = md5(name.encode()).hexdigest()
        first, step, size = int(mark[:8], 16), int(mark[8:16], 16) | 1, 8 * len(self.bits)
        places = ((first + i * step) % size for i in range(self.hashes))
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in places)


def name_filter(names: DataFrame, key: str = "file_name", size: int = FILTER_BITS, hashes: int = FILTER_HASHES) -> NameFilter:
    """The filter of the names in column ``key``. Tasks set bits in words of 64; at most ``size / 64`` words reach the driver."""
    mark = F.md5(key)
    first, step = (F.conv(F.substring(mark, at, 8), 16, 10).cast("long") for at in (1, 9))
    place = F.pmod(first + F.col("i") * step.bitwiseOR(F.lit(1)), F.lit(size))
    rows = names.filter(F.col(key).isNotNull()).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("place"), F.lit(64)).cast("int"))
    words = rows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(size // 64, "<i8")
    for word, bits in words.collect():
        table[word] = bits
    return NameFilter(table.tobytes(), hashes)


def _name(entry: str) -> str:
    """``base_name`` of an entry."""
    return re.sub(r"\.(txt|nxml)$", "", entry.rsplit("/", 1)[-1])


def _unpack(skip: NameFilter | None = None):
    """Reads archives entry by entry. A row may name the ``wanted`` entries of its archive; otherwise an entry that ``skip`` may
    hold is passed over: its text is not read, and its row says ``deferred``."""
    columns = ["archive", "entry_name", "text", "deferred"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, wanted in zip(batch["path"], batch["wanted"]):
                wanted = None if wanted is None else set(wanted)
                rows, size = [], 0
                with _open(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                    for entry in tar:
                        if not entry.isfile() or wanted is not None and entry.name not in wanted:
                            continue
                        if wanted is None and skip is not None and _name(entry.name) in skip:
                            rows.append((path, entry.name, None, True))
                            continue
                        text = tar.extractfile(entry).read().decode("utf-8", errors="replace")
                        rows.append((path, entry.name, text, False))
                        size += len(text)
                        if size >= BATCH_CHARS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _entries(placed: DataFrame, skip: NameFilter | None = None) -> DataFrame:
    rows = placed.mapInPandas(_unpack(skip), "archive string, entry_name string, text string, deferred boolean")
    name, kind = base_name(F.col("entry_name")), extension(F.col("entry_name"))
    return rows.select("archive", "entry_name", name.alias("file_name"), kind.alias("format"), "text", "deferred")


def read_archives(spark: SparkSession, path: str, glob: str = "*.tar.gz", skip: NameFilter | None = None) -> DataFrame:
    """``(archive, entry_name, file_name, format, text)`` of all articles in the archives of a folder.

    Only paths go to the tasks; each task streams its archives entry by entry, so neither the driver nor a
    task holds an archive. An archive cannot be split, so write the result once and work on that.

    With ``skip`` there is one more column: an article that the filter may hold is ``deferred``, its text is not decoded and
    null. The caller tells by an exact join which of these it wants and reads them with ``read_entries``.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.lit(None).cast("array<string>").alias("wanted"))
    )
    # One archive per task, as far as there are slots.
    entries = _entries(listed.repartitionByRange(max(1, listed.count()), "path"), skip)
    return entries.select(*schemas.ARCHIVE_ENTRIES.names, *(["deferred"] if skip is not None else []))


def read_entries(wanted: DataFrame) -> DataFrame:
    """The articles ``wanted(archive, entry_name)``; only their archives are opened, each with the list of its own entries."""
    placed = wanted.groupBy(F.col("archive").alias("path")).agg(F.collect_set("entry_name").alias("wanted"))
    return _entries(placed).select(*schemas.ARCHIVE_ENTRIES.names)


def read_except(
    spark: SparkSession, path: str, old: DataFrame, work: Callable[[DataFrame], DataFrame], glob: str = "*.tar.gz"
) -> DataFrame:
    """``work(entries)``, stored, of the articles whose name is not in ``old(file_name)``; old ones are not decoded.

    ``work`` takes entries and gives at least one row for each, with all their columns but the text. What the filter holds is
    judged by an exact anti join, so a name it says yes to by chance is read after all.
    """
    names = cut(old.select("file_name").distinct())
    first = cut(work(read_archives(spark, path, glob, name_filter(names))))
    passed = first.filter("deferred").select("archive", "entry_name", "file_name").distinct()
    missed = cut(passed.join(names, "file_name", "left_anti").select("archive", "entry_name"))
    again = cut(work(read_entries(missed).withColumn("deferred", F.lit(False))))
    return first.filter("not deferred").unionByName(again).drop("deferred")


def format_rank(fmt: str = "format") -> Column:
    """Rank of an article format: XML before plain text."""
    return F.when(F.col(fmt) == "nxml", 0).otherwise(1)
