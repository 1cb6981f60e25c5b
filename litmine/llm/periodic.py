"""Operator 12: runs of repeated words, by block convolution.

A run is a maximal stretch of words with smallest period q and at least ``max(12, 2 * q)`` words. For the dyadic scale b,
the blocks of b words at multiples of b look for runs with periods from 2b - 1 to 4b - 2: the first period of such a run holds
a whole block, and the block occurs again one period later. Where a block occurs is told by the sums of squared differences
between it and the window that follows, for all distances at once: block x block + window x window - 2 block x window, whose
last term is a convolution, taken by a number-theoretic transform. It is exact: words are numbered by integers, a sum is zero
only if every word is equal, and as many primes are used as the greatest possible sum needs. For distances under 31 (b < 16)
the differences are taken directly, which is cheaper than a transform. Every zero gives a distance, and from there the stretch
is extended to both sides as far as words at that distance are equal.

What is left out cannot hold a new run: a block with a word that does not come again within the greatest distance of the
scale; a block whose whole window lies in a run with a period of at most b, and an occurrence inside a known run whose period
divides its distance (both give that run again).

A text is dealt with in one task, as its runs may span all of it; the work is map-only, so nothing is shuffled, a hot source
is as good as any other, and a lost executor costs the tasks it had. Texts share vectorised steps in portions of a few MB;
the transforms are taken in portions of fixed size, so memory is bounded by the longest text.

Nulls and edges: a null or empty text has no words, no runs and an empty collapsed text; null ids are kept; repeated rows get
a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import portions, texts

SHORTEST = 12
WORD = r"[^\x20\x09-\x0D]+"

# Primes of the form k * 2^m + 1 with primitive root 3; the first allows transforms of up to 2^26 places.
PRIMES = (469762049, 167772161, 998244353)
ROOT = 3
# Blocks of fewer words are compared directly; places per portion of transforms; bytes of text per portion.
FIRST_BLOCK = 16
PLACES = 1 << 19
PORTION = 2 << 20


@cache
def _powers(half: int, prime: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``, as a column."""
    root = pow(ROOT, (prime - 1) // (2 * half), prime)
    step = pow(root, -1, prime) if inverse else root
    powers = np.ones(1, "uint64")
    while len(powers) < half:
        powers = np.concatenate([powers, powers * np.uint64(pow(step, len(powers), prime)) % np.uint64(prime)])
    return powers[:, None]


def transform(x: np.ndarray, prime: int) -> np.ndarray:
    """Forward transform of each column, places in bit-reversed order."""
    p, n, m = np.uint64(prime), *x.shape
    half = n // 2
    while half:
        pairs = x.reshape(-1, 2, half, m)
        low, high = pairs[:, 0], pairs[:, 1]
        x = np.empty_like(pairs)
        x[:, 0] = (low + high) % p
        x[:, 1] = (low + p - high) * _powers(half, prime, False) % p
        half //= 2
    return x.reshape(n, m)


def transform_back(x: np.ndarray, prime: int) -> np.ndarray:
    """Inverse of ``transform``."""
    p, n, m = np.uint64(prime), *x.shape
    half = 1
    while half < n:
        pairs = x.reshape(-1, 2, half, m)
        low, high = pairs[:, 0], pairs[:, 1] * _powers(half, prime, True) % p
        x = np.empty_like(pairs)
        x[:, 0] = (low + high) % p
        x[:, 1] = (low + p - high) % p
        half *= 2
    return x.reshape(n, m) * np.uint64(pow(n, -1, prime)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int) -> np.ndarray:
    """Sums of squared differences modulo ``prime`` between each column of ``blocks`` (b rows) and every stretch of b rows of
    the same column of ``windows`` (3b - 1 rows); 2b rows."""
    p, (b, m) = np.uint64(prime), blocks.shape
    blocks, windows = blocks.astype("uint64") % p, windows.astype("uint64") % p
    left, right = np.zeros((4 * b, m), "uint64"), np.zeros((4 * b, m), "uint64")
    left[:b], right[: 3 * b - 1] = blocks[::-1], windows
    product = transform_back(transform(left, prime) * transform(right, prime) % p, prime)[b - 1 : 3 * b - 1]
    summed = np.zeros((3 * b, m), "uint64")
    np.cumsum(windows * windows % p, axis=0, out=summed[1:])
    return ((blocks * blocks % p).sum(axis=0) + (summed[b:] - summed[:-b]) + (2 * p - 2 * product % p)) % p


def occurrences(words: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(x, d)`` at which the block of ``b`` words from ``x`` of ``starts`` occurs again at distance ``d``, for
    ``2b - 1 <= d < 4b - 1``. Places after the last word match nothing."""
    beyond = np.concatenate([words, np.zeros(4 * b + b, words.dtype)])
    most = b * (int(words.max(initial=0)) + 1) ** 2
    primes, product = [], 1
    for prime in PRIMES:
        if product <= most:
            primes.append(prime)
            product *= prime
    assert product > most, "a text of more words than the primes allow"
    found = [(np.empty(0, "int64"), np.empty(0, "int64"))]
    for i in range(0, len(starts), max(1, PLACES // (4 * b))):
        some = starts[i : i + max(1, PLACES // (4 * b))]
        zero = None
        for prime in primes:
            here = np.arange(len(some)) if zero is None else np.flatnonzero(zero.any(axis=0))
            if not len(here):
                break
            blocks = beyond[np.arange(b)[:, None] + some[here]]
            windows = beyond[np.arange(2 * b - 1, 5 * b - 2)[:, None] + some[here]]
            sums = squared_differences(blocks, windows, prime) == 0
            if zero is None:
                zero = sums
            else:
                zero[:, here] &= sums
        lag, column = np.nonzero(zero)
        found.append((some[column], lag + 2 * b - 1))
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def _same(left: np.ndarray, right: np.ndarray) -> int:
    """How many first items of two arrays of one length are equal."""
    done, step = 0, 64
    while done < len(left):
        equal = left[done : done + step] == right[done : done + step]
        if not equal.all():
            return done + int(equal.argmin())
        done, step = done + step, step * 2
    return len(left)


def _close(words: np.ndarray, shortest: int) -> list[np.ndarray]:
    """Runs ``(start, length, period)`` with periods under ``2 * FIRST_BLOCK - 1``: stretches of zero differences at each
    distance."""
    found = []
    for d in range(1, 2 * FIRST_BLOCK - 1):
        if len(words) <= d:
            break
        equal = np.zeros(len(words) - d + 2, "bool")
        np.equal(words[d:], words[:-d], out=equal[1:-1])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        start, length = edges[::2], edges[1::2] - edges[::2] + d
        long = length >= max(2 * d, shortest)
        if long.any():
            found.append(np.stack([start[long], length[long], np.full(int(long.sum()), d)], axis=1))
    return found


def _gaps(words: np.ndarray) -> np.ndarray:
    """Words up to the next place of the same word."""
    order = np.argsort(words, kind="stable")
    gaps = np.full(len(words), np.iinfo("int64").max)
    same = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _smallest(found: list[np.ndarray]) -> np.ndarray:
    """Runs by start and period; of those with one start and length the one of smallest period."""
    if not found:
        return np.empty((0, 3), "int64")
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _far(words: np.ndarray, bounds: np.ndarray, close: list[np.ndarray], shortest: int) -> list[np.ndarray]:
    """Runs with the other periods, by convolution of blocks, scale by scale; ``close`` has the runs known before."""
    lengths, gaps, known, b = np.diff(bounds), None, list(close), FIRST_BLOCK
    while (lengths >= 3 * b - 1).any():
        of = np.flatnonzero(lengths >= 3 * b - 1)
        counts = (lengths[of] - (3 * b - 1)) // b + 1
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(bounds[of], counts) + nth * b
        gaps = _gaps(words) if gaps is None else gaps
        again = gaps < 4 * b - 1
        met = np.concatenate([[0], np.cumsum(again)])
        starts = starts[met[starts + b] - met[starts] == b]
        runs = _smallest(known)
        for start, length, period in runs[(runs[:, 1] >= 5 * b) & (runs[:, 2] <= b)]:
            inside = slice(np.searchsorted(starts, start), np.searchsorted(starts, start + length - 5 * b + 2, "right"))
            starts = np.delete(starts, inside) if inside.stop > inside.start else starts
        if len(starts):
            known += _extended(words, *occurrences(words, starts, b), b, runs, shortest)
        b *= 2
    return known


def _extended(words: np.ndarray, x: np.ndarray, d: np.ndarray, b: int, runs: np.ndarray, shortest: int) -> list[np.ndarray]:
    order = np.argsort(x, kind="stable")
    x, d = x[order], d[order]
    new = np.ones(len(x), "bool")
    for start, length, period in runs[runs[:, 1] >= 3 * b - 1] if len(x) else ():
        part = slice(np.searchsorted(x, start), np.searchsorted(x, start + length))
        new[part] &= (x[part] + d[part] + b > start + length) | (d[part] % period != 0)
    x, d = x[new], d[new]
    order = np.lexsort((x, d))
    found, last, end = [], 0, 0
    for at, distance in zip(x[order].tolist(), d[order].tolist()):
        if distance == last and at + distance + b <= end:
            continue
        begin = at - _same(words[:at][::-1], words[distance : at + distance][::-1])
        end, last = at + distance + _same(words[at : len(words) - distance], words[at + distance :]), distance
        if end - begin >= max(2 * distance, shortest):
            found.append((begin, end - begin, distance))
    return [np.array(found, "int64")] if found else []


def runs_of(documents: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """The runs of each document, given as its words: rows ``(start, length, period)`` by start, then period."""
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in documents])]).astype("int64")
    flat, base = np.empty(bounds[-1], "int64"), 1  # numbers differ between documents, so no run crosses a bound
    for i, words in enumerate(documents):
        index: dict[bytes, int] = defaultdict(count(base).__next__)
        flat[bounds[i] : bounds[i + 1]] = np.fromiter(map(index.__getitem__, words), "int64", len(words))
        base += len(index)
    flat = flat.astype("int32")
    runs = _smallest(_far(flat, bounds, _close(flat, shortest), shortest))
    at = np.searchsorted(runs[:, 0], bounds)
    return [runs[a:z] - [start, 0, 0] for a, z, start in zip(at[:-1], at[1:], bounds[:-1])]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by spaces, without those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, "int64")
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist())


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Per row of ``docs`` its ``doc_id``, ``n_words``, ``runs`` (start, length and period in words, by start, then period)
    and ``collapsed``, the text without repeated words."""
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def portion(ids: pa.Array, raw: list[bytes]) -> pa.RecordBatch:
        documents = [x.split() for x in raw]  # bytes split at exactly the ASCII white space \x09-\x0d and \x20
        runs = runs_of(documents, shortest)
        places = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        flat = np.concatenate(runs)
        items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(entry))
        columns = [ids, pa.array(map(len, documents), pa.int64()), pa.ListArray.from_arrays(places, items)]
        columns.append(pa.array(map(collapse, documents, runs), pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, PORTION):
            yield portion(part.column("doc_id"), part.column("text").cast(pa.binary()).to_pylist())

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = texts(docs, "doc_id").mapInArrow(run, schema)
    return found.select("doc_id", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the words of some rows overwritten: with h the crc32 of the id and g = h / 10, rows with h % 10 = 0
    repeat from word a = g % n on the p = 1 + (n - a) / (3 + g % 8) words that begin there, up to the same number n of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = texts(docs, "doc_id").withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    p = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), F.ceil(rest / p).cast("int")))
    repeated: Column = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), rest))
    text = F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of each row of ``periodic_runs`` the number of runs, the longest one (ties: least start, then period), and hashes of
    all runs and of the collapsed text."""
    key = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    rows = found.withColumn("longest", F.array_min(key))
    length, period = -F.col("longest.l"), F.col("longest.p")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
