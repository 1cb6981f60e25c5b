"""Operator 13: alignment of the tokens of two tokenizers, by merge-path partitioning.

Both token sequences cut the same bytes, so their ends are two rising sequences. They are merged in pieces of equal work: the
merge path crosses the diagonal k where k ends of both together are taken, and a binary search on each diagonal gives how
many of them are of A, so that the pieces are known beforehand and each is merged on its own. A piece gives its overlaps, that
is an A token and a B token with common bytes, and whether both end there. At a bound between pieces an end of both sequences
may lie half in either piece: such an overlap is stitched. The overlaps at which both end close the groups; all A and B tokens
of a group are linked.

The texts of a portion are laid behind each other and merged as one sequence: both tokenizers end with every text, so no group
crosses from one to the next, and a long text is as many pieces as its tokens need.

The count of an id pair is the number of documents that hold it linked. Each document gives its different pairs once, with the
times they are linked, kept on shared storage. Counts are partial sums. The ``FREQUENT`` most frequent pairs, a fixed number,
are broadcast with their counts, so that most links never move and no pair is a hot key; the other pairs of the documents meet
their counts in a shuffle. The sums of a document are again partial sums.

Nulls and edges: a null or empty text, and one whose bytes a tokenizer does not give back, has no tokens: all its counts are 0
and its groups are empty; special tokens in a text are plain text; null ids are kept; repeated rows are documents each; other
columns are ignored; an empty table gives no rows. The pairs of one group are made in one task from its different ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from litmine.llm.common import portions, stored, texts
from litmine.llm.token_store import CACHE, Encoder, byte_letters

# Ends per piece of a merge; bytes of text per portion; links of a group that are made one by one; pairs that are broadcast.
PIECE = 1 << 14
PORTION = 1 << 20
SMALL = 256
FREQUENT = 16_384


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal k how many of the first k of the merged ends are of ``a``; of equal ends that of ``a`` is first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        taken = np.zeros(len(low), "bool")
        taken[open_] = a[middle[open_]] <= b[diagonals[open_] - middle[open_] - 1]
        low, high = np.where(open_ & taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int):
    """Overlaps of a piece whose ends ``a`` and ``b`` begin at places ``i`` and ``j`` of the sequences: the place of the A token,
    of the B token, the end, and whether both tokens end there."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")  # two rising sequences are merged in one pass; ``a`` first
    ends, of_b = ends[order], order >= len(a)
    again = np.zeros(len(ends) + 1, "bool")
    again[1:-1] = ends[1:] == ends[:-1]
    before_b = np.cumsum(of_b) - of_b
    first = ~again[:-1]
    return i + (np.arange(len(ends)) - before_b)[first], j + before_b[first], ends[first], again[1:][first]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Overlaps of two sequences of token ends: pieces of ``piece`` ends are merged each on its own, then stitched."""
    diagonals = np.minimum(np.arange(0, len(a) + len(b) + piece, piece), len(a) + len(b))
    i = crossings(a, b, diagonals)
    j = diagonals - i
    done = []
    for k in range(len(diagonals) - 1):
        of_a, of_b, ends, closed = merge_piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k])
        if done and len(ends) and done[-1][2][-1] == ends[0]:  # A ended in the last piece, B ends at the same byte here
            done[-1][3][-1] = True
            of_a, of_b, ends, closed = of_a[1:], of_b[1:], ends[1:], closed[1:]
        if len(ends):
            done.append((of_a, of_b, ends, closed))
    if not done:
        return tuple(np.empty(0, kind) for kind in ("int64", "int64", "int64", "bool"))
    return tuple(np.concatenate(x) for x in zip(*done))


class Tokenizers:
    """The two tokenizers of a Python worker, the bytes of their tokens, and the texts of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder.of(a_path), SentencePieceProcessor(model_file=b_path)
        letters = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        a_texts, b_texts = [b"%d" % i for i in range(len(self.a_bytes))], [b"%d" % i for i in range(len(self.b_bytes))]
        self.written = [
            *(x + b"," for x in a_texts), *(x + b"|" for x in a_texts), *(x + b"," for x in b_texts), *(x + b";" for x in b_texts)
        ]

    def encode(self, raw: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers of every text; none where the tokens' bytes are not a space and the text."""
        if len(self.a.seen) > CACHE:
            self.a.seen.clear()
        decoded = [x.decode("utf-8", "replace") for x in raw]
        none = np.empty(0, "int64")
        in_a, in_b = [], []
        for x, text, b in zip(raw, decoded, self.b.encode(decoded, num_threads=1)):
            packed = b"".join(map(self.a.seen.__getitem__, self.a.pieces(" " + text))) if x else b""
            a = np.frombuffer(packed, "<u4")
            if x:
                whole = b" " + x
                right = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole
                right = right and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            in_a.append(a.astype("int64") if x and right else none)
            in_b.append(np.array(b, "int64") if x and right else none)
        return in_a, in_b


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def linked_pairs(a, b, a_from, b_from, sizes_a, sizes_b, document, n_a: int, n_b: int):
    """Different ``(document, a id, b id)`` as one number, and how often each is linked."""
    all_links = sizes_a * sizes_b
    small = np.flatnonzero(all_links <= SMALL)
    links = all_links[small]
    group = np.repeat(small, links)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    keys = [(document[group] * n_a + a[a_from[group] + nth // sizes_b[group]]) * n_b + b[b_from[group] + nth % sizes_b[group]]]
    times = [np.ones(len(group), "int64")]
    for g in np.flatnonzero(all_links > SMALL):
        ids_a, times_a = np.unique(a[a_from[g] : a_from[g] + sizes_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[b_from[g] : b_from[g] + sizes_b[g]], return_counts=True)
        keys.append((((document[g] * n_a + ids_a) * n_b)[:, None] + ids_b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(times), len(found)).astype("int64")


def align_portion(tools: Tokenizers, ids: pa.Array, raw: list[bytes | None], piece: int) -> pa.RecordBatch:
    in_a, in_b = tools.encode(raw)
    a, b = np.concatenate(in_a), np.concatenate(in_b)
    a_ends, b_ends = np.cumsum(tools.a_sizes[a]), np.cumsum(tools.b_sizes[b])
    of_a, of_b, ends, closed = overlaps(a_ends, b_ends, piece)
    a_to, b_to, ends = of_a[closed] + 1, of_b[closed] + 1, ends[closed]
    a_from, b_from = np.r_[0, a_to][:-1], np.r_[0, b_to][:-1]
    sizes_a, sizes_b = a_to - a_from, b_to - b_from

    count_a, count_b = np.array([*map(len, in_a)]), np.array([*map(len, in_b)])
    text_ends = np.r_[0, a_ends][np.cumsum(count_a)]
    last = np.searchsorted(ends, text_ends, "right")
    counts = np.diff(last, prepend=0)
    document = np.repeat(np.arange(len(raw)), counts)
    n_links = np.diff(np.r_[0, np.cumsum(sizes_a * sizes_b)][last], prepend=0)

    codes = np.empty(len(a) + len(b), "int64")
    n_a, n_b = len(tools.a_bytes), len(tools.b_bytes)
    code_a, code_b = a.copy(), b + 2 * n_a
    code_a[a_to - 1] += n_a
    code_b[b_to - 1] += n_b
    codes[np.arange(len(a)) + np.repeat(b_from, sizes_a)] = code_a
    codes[np.arange(len(b)) + np.repeat(a_to, sizes_b)] = code_b
    written = list(map(tools.written.__getitem__, codes.tolist()))
    at = np.r_[0, np.cumsum(count_a + count_b)].tolist()
    groups = [b"".join(written[s:e])[:-1].decode() for s, e in zip(at[:-1], at[1:])]

    keys, times = linked_pairs(a, b, a_from, b_from, sizes_a, sizes_b, document, n_a, n_b)
    places = pa.array(np.searchsorted(keys, np.arange(len(raw) + 1) * (n_a * n_b)), pa.int32())
    as_list = lambda values: pa.ListArray.from_arrays(places, pa.array(values.astype("int32")))
    columns = [ids, *map(pa.array, (count_a, count_b, counts, n_links)), pa.array(groups, pa.string())]
    columns += [as_list(keys // n_b % n_a), as_list(keys % n_b), as_list(times)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"])


def align(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE) -> DataFrame:
    """Per row of ``docs`` its ``doc_id``, the numbers of A tokens, B tokens, groups and links, ``groups`` as
    ``a1,a2|b1;a3|b2,b3`` of ids in order, and its different linked id pairs ``a``, ``b`` with the ``times`` they are linked. A
    is a byte-level tokenizer file and gets a space before the text; B is a SentencePiece file that adds one itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(a_path, b_path)
        for part in portions(batches, PORTION):
            yield align_portion(tools, part.column("doc_id"), part.column("text").cast(pa.binary()).to_pylist(), piece)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
    return texts(docs, "doc_id").mapInArrow(run, schema + "a array<int>, b array<int>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, documents, best)``: in how many documents a pair is linked, and whether no pair of its A id is in more. An A id
    has no more partners than B has tokens."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("pair")).select("pair.a", "pair.b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("documents"))
    most = F.max("documents").over(Window.partitionBy("a"))
    return counts.withColumn("best", F.col("documents") == most)


def alignment_scores(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """``align`` in digests, with ``n_best``, links whose pair is the most frequent of its A id, and ``count_sum``, the
    sum of the counts over all links."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = align(docs, a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "times")
    aligned = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned), "pairs")
    frequent = stored(counts.orderBy(F.desc("documents"), "a", "b").limit(frequent), "frequent")
    links = aligned.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("pair"))
    links = links.select("row", "pair.a", "pair.b", "pair.times")
    rest = links.join(F.broadcast(frequent), ["a", "b"], "left_anti").hint("merge").join(counts, ["a", "b"])
    met = links.join(F.broadcast(frequent), ["a", "b"]).unionByName(rest)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("documents")).alias("count_sum"),
    )
    nothing = F.lit(0).cast("long")
    return aligned.drop("a", "b", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nothing).alias("n_best"),
        F.coalesce("count_sum", nothing).alias("count_sum"), "groups_sha256",
    )
