"""Operator 2: token ids in ORC files.

Texts are encoded with a tokenizer file, an end id is put after each document, and the ids are written in ascending
``doc_id`` order as ORC. ORC gives what the store needs: integers are run-length encoded, every stripe holds row indexes
with the least and greatest ``doc_id`` of each row group and a Bloom filter on it, and readers split a file at its stripes.
A second, tiny ORC table has one row per part with its span of ids and of documents, so that a document's place among all
ids is its place in the part plus the ids of the parts before.

The order comes from a range shuffle of the texts, which are smaller than their ids; encoding and writing follow in the
same task. Encoding remembers pieces of text between white space: no token spans the gap between a word and the white
space after it, so pieces can be encoded on their own, and the tokenizer sees each piece once per worker.

Nulls and edges: a null text is the empty text and has the end id only; rows with a null id come first; rows with equal ids
are ordered by their text; other columns are ignored; an empty table gives a store without rows.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.llm.common import texts

END_ID = 0
CACHE = 1_000_000
STRIPE_BYTES = 32 << 20
ROWS_PER_INDEX = 1_000

# White space as the tokenizer's pattern understands it.
_WIDE = (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE = "\t-\r \x85\xa0" + "".join(map(chr, _WIDE))
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_UNSAFE = re.compile(f"[{_SPACE}\0][ \n]|\0")
# The same for texts of one byte per character: white space but space and line feed and the mark, and pairs of these two.
_RARE = tuple(bytes([b]) for b in b"\t\x0b\x0c\r\x85\xa0\0")
_PAIRS = (b"  ", b"\n\n", b" \n", b"\n ")
# Fixed value: how a byte-level tokenizer cuts a text before it merges.
_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

ROWS = "part int, doc_id long, place long, ids array<int>"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one of the
    letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def unsafe(text: str) -> bool:
    """Whether a space or line feed stands after white space, or the text holds the mark of the short way. Most texts have one
    byte per character, in which a search for bytes is much faster than the pattern."""
    try:
        letters = text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNSAFE.search(text) is not None
    if any(x in letters for x in _RARE):
        return _UNSAFE.search(text) is not None
    return any(x in letters for x in _PAIRS)


class _Pieces(dict):
    """Packed ids of pieces of text, made by the tokenizer's model when first asked for."""

    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, byte_letters()

    def word(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return array("I", [x.id for x in found]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        parts = _TOKEN.findall(piece)
        ids = self.word(piece) if len(parts) < 2 else b"".join(map(self.__getitem__, parts))
        self[piece] = ids
        return ids


class Encoder:
    """Texts to packed little-endian 32-bit ids, as the tokenizer's own ``encode`` gives them; one per Python worker and
    tokenizer file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen = _Pieces(self.tokenizer)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def pieces(self, text: str) -> list[str]:
        """Cut before white space that follows other characters. The short way is right if every space or line feed stands
        after another kind of character."""
        if unsafe(text):
            return _PIECE.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.seen) > CACHE:
            self.seen.clear()
        return b"".join(map(self.seen.__getitem__, self.pieces(text)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the store: ``path``/ids and ``path``/parts."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                packed = [encoder.encode(x) + end for x in rows.column("text").to_pylist()]
                lengths = np.fromiter((len(x) // 4 for x in packed), dtype="int64", count=len(packed))
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                )
                columns = [pa.array(np.full(len(packed), part, "int32")), rows.column("doc_id"), pa.array(place + offsets[:-1]), ids]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                place += int(offsets[-1])

    rows = texts(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd",
        "orc.stripe.size": STRIPE_BYTES,
        "orc.row.index.stride": ROWS_PER_INDEX,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": 0.01,
    }
    rows.mapInArrow(run, ROWS).write.options(**options).orc(f"{path}/ids")
    stored = read_tokens(docs.sparkSession, path)
    parts = stored.groupBy("part").agg(
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.count("*").alias("documents"),
        F.max(F.col("place") + F.size("ids")).alias("n_ids"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only theirs, for which stripes and row groups are skipped by index and filter."""
    rows = spark.read.schema(ROWS).orc(f"{path}/ids")
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<i4")).view("uint8"))
            crc = [crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column("part"), batch.column("doc_id"), batch.column("place")]
            columns += [pa.array(np.diff(offsets).astype("int64")), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).mapInArrow(run, "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    parts = spark.read.schema("part int, start long").orc(f"{path}/parts")
    return rows.join(parts, "part").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
