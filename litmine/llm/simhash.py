"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a word between them that differs from each in at most two. So every
fingerprint emits all 2,081 words within half the radius, and fingerprints that emit the same word are within the radius.
The words are not shuffled one by one: they are keyed by their low bits, a fingerprint is sent once to each key that its
words have, and the task of the key makes the words, sorts them and finds the equal ones. Of the fingerprints that share
a word only links to the smallest are kept, and of the links of a task a spanning forest, so that a group of m near copies
gives of the order of m links, not m squared, and no connection is lost.

Equal fingerprints are one node. Components are found by ``components``.

Nulls and edges: a null text is the empty text, whose fingerprint is zero; null ids are not considered for
``component_id``, which is null only if no row of the component has an id; repeated rows are returned each; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from litmine.llm.common import numbered, stored, texts
from litmine.llm.components import components

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4

# Words made by one task at a time, and the least number of key bits.
WORDS_PER_TASK = 4_000_000
MIN_KEY_BITS = 9


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of ``size`` words in A-Z lower case; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.empty(0, dtype="uint64")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1)
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="uint64")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    counts = np.zeros(BITS, dtype="int64")
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view("uint8").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``print`` of every row; the 64 bits as a signed long. Only the text goes to Python."""

    def run(values: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(shingle_hashes(x.as_py())) for x in values], dtype="uint64")
        return pa.array(prints.view("int64"), pa.int64())

    return texts(docs, key, text=text).select(F.col(key).cast("long").alias(key), F.arrow_udf(run, "long")("text").alias("print"))


def masks(low: int, high: int, radius: int) -> list[np.ndarray]:
    """For r = 0..radius all masks of r bits among the bits low..high-1."""
    one = [np.uint64(1 << i) for i in range(low, high)]
    out = []
    for r in range(radius + 1):
        out.append(np.array([np.bitwise_or.reduce(c) if c else np.uint64(0) for c in combinations(one, r)], dtype="uint64"))
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of the nodes 0..n-1 reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def links_of_key(prints: np.ndarray, key: int, bits: int, part: int, parts: int, radius: int = RADIUS) -> np.ndarray:
    """Links (two columns) among sorted ``prints`` that share a word with the low bits ``key``. With several ``parts``
    only the words of one part are looked at; together the parts see every word."""
    half = radius // 2
    low = np.uint64((1 << bits) - 1)
    away = np.bitwise_count((prints ^ np.uint64(key)) & low)
    words, owners = [], []
    by_size = masks(bits, BITS, half)
    for flipped in range(half + 1):
        mine = np.flatnonzero(away == flipped)
        flips = np.concatenate(by_size[: half - flipped + 1])
        block = max(1, 1_000_000 // len(flips))
        for start in range(0, len(mine), block):
            at = mine[start : start + block]
            made = ((prints[at] | low) ^ flips[:, None]).ravel()
            own = np.tile(at, len(flips)).astype("int32")
            if parts > 1:
                chosen = (made * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts) == np.uint64(part)
                made, own = made[chosen], own[chosen]
            words.append(made)
            owners.append(own)
    made, own = np.concatenate(words), np.concatenate(owners)
    order = np.argsort(made, kind="stable")
    made, own = made[order], own[order]
    again = np.concatenate([[False], made[1:] == made[:-1]])
    if not again.any():
        return np.empty((0, 2), dtype="uint64")
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(made))))[again]  # where the run of equal words begins
    pairs = np.unique(own[first].astype("int64") * len(prints) + own[again])
    a, b = pairs // len(prints), pairs % len(prints)
    near = (np.bitwise_count(prints[a] ^ prints[b]) <= radius) & (a != b)
    root = forest(a[near], b[near], len(prints))
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return np.stack([prints[linked], prints[root[linked]]], axis=1)


def links(nodes: DataFrame, words_per_task: int = WORDS_PER_TASK, min_key_bits: int = MIN_KEY_BITS) -> DataFrame:
    """``(a, b)``: links between different fingerprints (column ``print``) that connect all that differ in at most
    ``RADIUS`` bits."""
    emitted = sum(len(m) for m in masks(0, BITS, RADIUS // 2))
    bits = max(min_key_bits, int(nodes.count() * emitted // words_per_task).bit_length())
    flips = np.concatenate(masks(0, bits, RADIUS // 2)).astype("int64").tolist()
    low = (1 << bits) - 1
    keyed = nodes.select("print", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(
        "print", F.col("print").bitwiseAND(F.lit(low)).bitwiseXOR(F.col("flip")).alias("key")
    )
    whole = F.expr(f"count_if((print & {low}) = key)")  # those make nearly all words of a key
    heavy = keyed.groupBy("key").agg(F.ceil(whole * emitted / words_per_task + F.count("*") / words_per_task).alias("parts"))
    heavy = heavy.filter("parts > 1")
    keyed = keyed.join(heavy, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    keyed = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def find(group: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(group["print"].to_numpy().astype("int64").view("uint64"))
        found = links_of_key(prints, int(group["key"].iloc[0]), bits, int(group["part"].iloc[0]), int(group["parts"].iloc[0]))
        return pd.DataFrame(found.view("int64"), columns=["a", "b"])

    return keyed.groupBy("key", "part").applyInPandas(find, "a long, b long")


def rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` (different fingerprints) with the ``root`` of their components, on shared storage."""
    roots = components(links(nodes.select("print")))
    joined = nodes.join(roots, nodes["print"] == roots["node"], "left")
    return stored(joined.select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "print").alias("root")), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``."""
    prints = stored(fingerprints(docs), "prints")
    found = rooted(stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes"))
    least = stored(found.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of_print = stored(found.join(least, "root").select("print", "component_id"), "components")
    return prints.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, without_id: bool = False) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest ``doc_id``, and of these the first by its row
    key, so that rows which share an id are told apart. Components in which no row has an id are kept if ``without_id``."""
    rows = numbered(docs)
    prints = fingerprints(rows, "row", "doc.text")
    prints = stored(prints.join(rows.select("row", F.col("doc.doc_id").alias("doc_id")), "row"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = rooted(stored(prints.groupBy("print").agg(F.min(order).alias("first")), "nodes"))
    stays = found.groupBy("root").agg(F.min("first").alias("first"))
    if not without_id:
        stays = stays.filter(~F.col("first.none"))
    kept = rows.join(stays.select(F.col("first.row").alias("row")), "row", "left_semi")
    return kept.select(*[F.col("doc").getField(name).alias(name) for name in docs.columns])
