"""Operator 9: quality rules with cross-document line frequency.

Base rules look at one text: its length in words and the share of words in repeated 8-word windows. The cross-document
rule hashes the normalised lines, counts on how many distinct documents of a host each line stands, removes the lines
above the limit, and rejects a document that is depleted by that: too few of its words remain. The text without these
lines is part of the result; the base measures are those of the whole text.

Exact copies of a text are one document to the count, as a copied text says nothing about boilerplate; copies are the
matter of deduplication. A line is above the limit if it stands on more than ``Limits.documents`` documents of the host, a
count that is the same however many documents the host has. ``Limits.share`` can only lower it, on a host of which this share
is fewer documents, and not below ``Limits.least``; with the default share of 1 it never does.

Nulls and edges: a null text has no words, so its document fails the base rules, and stays null; a null host is a host of its own; blank
lines are never counted; repeated rows are judged each and count once; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import stored, texts

WINDOW = 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """``remaining``: share of its words that a document keeps at least when lines above the limits are removed."""

    min_words: int = 20
    repeat_percent: int = 30
    documents: int = 20
    share: float = 1.0
    least: int = 10
    remaining: float = 0.3


LIMITS = Limits()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, its first place included. Windows are compared
    exactly: ids of words are doubled into ids of 2, 4 and 8 words."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype="int64", count=n)
    if len(index) > n - window:  # a repeated window repeats eight words
        return 0
    length = 1
    while length < window:
        pairs = ids[:-length] * np.int64(n + 1) + ids[length:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        length *= 2
        if len(found) == len(pairs):
            return 0
    twice = counts[ids] > 1
    marks = np.zeros(n + 1, dtype="int64")
    marks[:-window] += twice
    marks[window:] -= twice
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the ASCII white space \\x09-\\x0d and \\x20
    blank = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - blank, sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)
    )


def line_hash(line: str) -> int:
    """Hash of a line in lower case with single spaces; equal for equal normalised lines."""
    return xxhash.xxh64_intdigest(" ".join(line.lower().split()).encode("utf-8", "replace")) - (1 << 63)


def document_lines(text: str) -> tuple[list[int], list[int]]:
    """Hashes of the different lines with a word, and the words on all lines with that hash."""
    total: dict[int, int] = {}
    for line in text.split("\n"):
        if n := len(line.encode("utf-8", "replace").split()):
            h = line_hash(line)
            total[h] = total.get(h, 0) + n
    return list(total), list(total.values())


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        values = np.array([measures(x) for x in batch["text"]], dtype="int64").reshape(-1, 5)
        lines = [document_lines(x) for x in batch["text"]]
        copy = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in batch["text"]]
        out = batch.drop(columns="text").assign(**dict(zip(names, values.T)), copy=copy)
        yield out.assign(hashes=[x[0] for x in lines], words=[x[1] for x in lines])


def keyed(docs: DataFrame, host: str = "source") -> DataFrame:
    """``(doc, key, key2)``: every row as a struct, and hashes of its id, host and text, with which a verdict finds its way
    back to the text without a second copy of it. Rows with the same keys have the same verdict, also with a null id."""
    of = [x for name in ("doc_id", host, "text") for x in (F.col(name).isNull(), F.col(name))]
    return docs.select(F.struct("*").alias("doc"), F.xxhash64(*of).alias("key"), F.xxhash64(*of[::-1]).alias("key2"))


def measured(rows: DataFrame, host: str = "source") -> DataFrame:
    """Per row of ``keyed`` documents the base measures, a hash of its text and the hashes and words of its lines, on
    shared storage."""
    rows = texts(rows, "key", "key2", F.xxhash64(F.col(f"doc.{host}")).alias("host"), text="doc.text")
    schema = (
        "key long, key2 long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, copy long, hashes array<long>, words array<long>"
    )
    return stored(rows.mapInPandas(_measure, schema).withColumn("row", F.monotonically_increasing_id()), "lines")


def frequent_lines(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``(host, hash)`` of the lines above the limits. Copies are reduced to one per host and text before lines are counted,
    and the counts are partial sums, however many documents share a line."""
    distinct = rows.groupBy("host", "copy").agg(F.first("hashes").alias("hashes"))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("documents"))
    lines = distinct.select("host", F.explode("hashes").alias("hash"))
    least = min(limits.least, limits.documents)
    many = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    lowered = F.greatest(F.lit(least), limits.share * F.col("documents"))
    limit = F.least(F.lit(limits.documents), lowered)
    return many.join(hosts, "host").filter(F.col("n") > limit).select("host", "hash")


def without_lines(text: str, removed: set[int]) -> str:
    """The text without its lines whose hash is in ``removed``; lines without a word stay."""
    return "\n".join(
        line for line in text.split("\n") if line_hash(line) not in removed or not line.encode("utf-8", "replace").split()
    )


def _cleaned(text: pa.Array, removed: pa.Array) -> pa.Array:
    done = []
    for start in range(0, len(text), 256):
        pairs = zip(text.slice(start, 256).to_pylist(), removed.slice(start, 256).to_pylist())
        done.append(pa.array([None if x is None else without_lines(x, set(r)) for x, r in pairs], pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def cleaned() -> Column:
    """The text of ``doc`` without the lines in ``removed``; only texts that have some go through Python."""
    text = F.col("doc.text").cast("string")
    changed = F.when(F.col("removed").isNotNull(), text)
    return F.coalesce(F.arrow_udf(_cleaned, "string")(changed, "removed"), text)


def verdicts(rows: DataFrame, host: str = "source", limits: Limits = LIMITS) -> DataFrame:
    """By the keys of ``keyed`` documents the base measures, ``base_failed``, ``removed_words``, ``kept`` and ``removed``,
    the hashes of the lines above the limits (null if there are none)."""
    base = measured(rows, host)
    lines = stored(frequent_lines(base, limits), "frequent")
    on_lines = base.select("row", "host", F.explode(F.arrays_zip("hashes", "words")).alias("line")).select(
        "row", "host", F.col("line.hashes").alias("hash"), F.col("line.words").alias("words")
    )
    removed = on_lines.join(lines, ["host", "hash"]).groupBy("row").agg(
        F.sum("words").alias("removed_words"), F.collect_list("hash").alias("removed")
    )
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")
    )
    depleted = F.col("n_words") - F.col("removed_words") < limits.remaining * F.col("n_words")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed"]
    judged = base.withColumn("base_failed", failed).join(removed, "row", "left").na.fill(0, ["removed_words"])
    once = judged.groupBy("key", "key2").agg(*[F.first(name).alias(name) for name in names])
    return once.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, host: str = "source", limits: Limits = LIMITS) -> DataFrame:
    """The base measures, ``base_failed``, ``removed_words`` (on lines above the limits), ``kept`` and the ``text`` without
    these lines of every row."""
    rows = keyed(docs.select(*dict.fromkeys(["doc_id", "text", host])), host)
    judged = rows.join(verdicts(rows, host, limits), ["key", "key2"])
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "removed_words", "kept", cleaned().alias("text"),
    )


def kept_documents(docs: DataFrame, host: str = "source", limits: Limits = LIMITS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; ``text`` is without the lines above the limits. The verdict
    is joined by id, host and text, so null and shared ids do not matter."""
    rows = keyed(docs, host)
    kept = rows.join(verdicts(rows, host, limits).filter("kept").select("key", "key2", "removed"), ["key", "key2"])
    return kept.select(*[
        (cleaned() if name == "text" else F.col("doc").getField(name)).alias(name) for name in docs.columns
    ])
