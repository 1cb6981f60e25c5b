"""Operator 7: toxicity after noisy-channel deobfuscation.

1. A character model is counted over the whole corpus: four-letter windows of letters, word boundary and other
   characters, added up per task and then by Spark. Its table has a fixed size.
2. Every token that looks disguised, by letters beside look-alikes or by different look-alikes alone that are mostly not
   digits (``@$$``), becomes a lattice of readings: a look-alike character may stand for letters, a
   separator may be nothing or a boundary, a run of three or more equal letters may be one or two, and a row of single
   characters may be one word. Viterbi decoding picks the reading that the character model finds likeliest.
3. A sparse logistic model over the words of the restored text and their first 4 to 7 letters gives the score. Its words
   have runs of equal letters cut to one, so that any number of repeated letters gives the same word. The value of a
   feature is the logarithm of the number of different written words that have it.

Nulls and edges: a null text is the empty text, which has the score of the bias; rows with a null ``doc_id`` are scored
like any other and are ``held_out`` = false; repeated rows are scored each; other columns are ignored; an empty label
table gives 0.5 for all; an empty document table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import crc_mod, texts
from litmine.llm.ftrl import Model, Settings, labelled_sample, scores, train

SETTINGS = Settings(alpha=3.0, l1=8.0, l2=0.0, rounds=4, shards=4)
# Lengths of the word beginnings that are features beside the whole word.
PREFIXES = range(4, 8)
THRESHOLD = 0.7

# The letters that a look-alike character may stand for, and characters put between letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiouh",
}
SEPARATORS = " .-_*'`~/,"

# Log cost of a reading: as written, look-alike read as a letter, separator dropped, letters doubled.
AS_WRITTEN, DISGUISE, DROPPED, DOUBLED = 0.0, -1.0, -0.5, -1.0

SYMBOLS = 28  # word boundary, a to z, any other character
ORDER = 4
CACHE = 400_000

_BOUNDARY, _OTHER = 0, 27
_CODES = bytes(
    _BOUNDARY if c <= 32 else c - 96 if 97 <= c <= 122 else _OTHER if c >= 128 else _BOUNDARY for c in range(256)
)
_ENDS = re.compile(r"^[^\w$@€£(|+!*#]+|(?:[?.,;:)\]}\"']+|([^\w$@€£(|+!*#])\1+)$")
_DISGUISED = re.compile(r"[^\W\d_].*[0-9@$!|+(€£*#]|[0-9@$!|+(€£*#].*[^\W\d_]|[^\W\d_][.\-_'`~/,][^\W\d_]|(.)\1\1")
_SIGNS, _ALIKE = re.compile(r"[@$!|+(€£*#]"), re.compile(r"[0-9@$!|+(€£*#]+")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")

FLUSH = 512  # places after which what all readings begin with is written out

Lattice = Iterable[list[tuple[str, float]]]


# Windows that are counted at once.
PORTION = 4 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace").translate(_CODES), dtype="uint8")


def window_counts(docs: DataFrame) -> DataFrame:
    """``(window, n)``: how often each four-symbol window stands in the texts, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some, size = np.zeros(SYMBOLS**ORDER, dtype="int64"), [], 0
        for batch in batches:
            for text in batch["text"]:
                c = np.concatenate([np.zeros(3, "uint8"), _codes(text), np.zeros(1, "uint8")]).astype("int32")
                some.append(((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:])
                size += len(c)
                if size > PORTION:  # the table is far larger than a text, so it is gone through once for many
                    total += np.bincount(np.concatenate(some), minlength=len(total))
                    some, size = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, "int32"), *some]), minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"window": used, "n": total[used]})

    return docs.select("text").mapInPandas(count, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


def character_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of each window given the three before it, mixed with shorter contexts."""
    n = counts.reshape((SYMBOLS,) * ORDER).astype("float64")
    p = np.full((SYMBOLS,) * ORDER, 1.0 / SYMBOLS)
    for drop in (3, 2, 1, 0):  # from no context to three symbols
        part = n.sum(axis=tuple(range(drop)), keepdims=True)
        p = (part + 4.0 * p) / (part.sum(axis=-1, keepdims=True) + 4.0)
    return np.log(p).astype("float32").ravel()


def count_model(docs: DataFrame) -> np.ndarray:
    """The character model of a corpus; at most ``SYMBOLS ** ORDER`` counts come to the driver."""
    rows = window_counts(docs).toPandas()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[rows["window"].to_numpy(dtype="int64")] = rows["n"].to_numpy(dtype="float64")
    return character_model(counts)


def lattice(token: str) -> Lattice:
    """Readings of each place of a lower-case token, as (what is read, log cost)."""
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run[1], len(run[0])
        if c.isalpha():
            yield [(c, AS_WRITTEN), (c * 2, DOUBLED)] if n > 2 else [(c * n, AS_WRITTEN)]
            continue
        readings = [(c, 2 * DISGUISE)] if c.isdigit() else [(" ", AS_WRITTEN)]
        readings += [(x, DISGUISE) for x in LOOKALIKES.get(c, "")]
        if c in SEPARATORS:
            readings.append(("", DROPPED))
        yield from [readings] * (1 if c in SEPARATORS else min(n, 2))


def _shared_begin(nodes: list[list]) -> str:
    """What the paths to all ``nodes`` begin with; the paths are cut after it."""
    paths = []
    for node in nodes:
        path = []
        while node is not None:
            path.append(node)
            node = node[0]
        paths.append(path[::-1])
    n = 0
    for level in zip(*paths):
        if any(node is not level[0] for node in level):
            break
        n += 1
    read = "".join(node[1] for node in paths[0][:n])
    if n:
        paths[0][n - 1][:] = None, ""
    return read


def decode(places: Lattice, model: np.ndarray) -> str:
    """The likeliest reading of a lattice (Viterbi; the state is the last three symbols), of any length: a state points
    back to the one before, and what all paths share is written out. Ties go to the reading that comes first in the order
    of places and readings."""
    states: dict[int, tuple[float, list]] = {0: (0.0, [None, ""])}
    size = SYMBOLS ** (ORDER - 1)
    done: list[str] = []
    for place, readings in enumerate(chain(places, [[(" ", 0.0)]]), 1):
        after: dict[int, tuple[float, list, str]] = {}
        for state, (total, node) in states.items():
            for what, cost in readings:
                at, value = state, total + cost
                for c in what:
                    code = _CODES[ord(c)] if ord(c) < 128 else _OTHER
                    if c.isdigit():
                        code = _OTHER
                    if code == _BOUNDARY and at % SYMBOLS == _BOUNDARY:
                        continue  # boundaries in a row count once
                    window = at * SYMBOLS + code
                    value += float(model[window])
                    at = window % size
                if at not in after or value > after[at][0]:
                    after[at] = (value, node, what)
        states = {at: (value, [node, what]) for at, (value, node, what) in after.items()}
        if place % FLUSH == 0:
            done.append(_shared_begin([node for _, node in states.values()]))
    best = max(states.values(), key=lambda x: x[0])[1]
    return "".join(done) + _shared_begin([best])


def restore(token: str, model: np.ndarray) -> list[str]:
    """Words of one token without white space: itself if nothing about it looks disguised, else its likeliest reading."""
    token = token.lower()
    if (bare := token.rstrip(".,")).isalpha() and not _TRIPLE.search(bare):
        return [bare]  # as most are
    token = _ENDS.sub("", _ENDS.sub("", token))
    if _DISGUISED.search(token):
        if not any(c.isalpha() for c in token):
            return re.findall(r"[^\W_]+", token)  # numbers hold no word to restore
        token = decode(lattice(token), model)
    elif len(token) > 2 and len(set(token)) > 1 and 2 * len(_SIGNS.findall(token)) > len(token) and _ALIKE.fullmatch(token):
        letters = ([reading for reading in place if reading[0] != " "] for place in lattice(token))
        token = decode(letters, model)  # blanks alone would be the cheapest reading
    return re.findall(r"[^\W_]+", token)


def spaced_rows(tokens: list[str]) -> list[str]:
    """Rows of three or more one-character tokens, space-joined."""
    lengths = np.fromiter(map(len, tokens), dtype="int32", count=len(tokens)) == 1
    if int(lengths.sum()) < 3:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], lengths.view("int8"), [0]])))
    return [" ".join(tokens[a:b]) for a, b in zip(edges[::2], edges[1::2]) if b - a > 2]


class Words(dict):
    """From a text to the features of its restored words; remembers the features of tokens, up to ``CACHE`` of them."""

    def __init__(self, model: np.ndarray, buckets: int):
        self.model, self.buckets = model, buckets

    def ids(self, words: list[str]) -> bytes:
        """Bucket ids of the words and of their beginnings, as packed 32-bit integers."""
        out = array("I")
        for word in words:
            word = _RUN.sub(r"\1", word)
            out.append(crc32(word.encode("utf-8", "replace")) % self.buckets)
            for k in PREFIXES:
                if len(word) >= k:
                    out.append(crc32(b"^" + word[:k].encode("utf-8", "replace")) % self.buckets)
        return out.tobytes()

    def __missing__(self, token: str) -> bytes:
        found = self[token] = self.ids(restore(token, self.model))
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        if len(self) > CACHE:
            self.clear()
        found = list(map(self.__getitem__, set(tokens)))
        for row in spaced_rows(tokens):
            found.append(self.ids(decode(lattice(row.lower()), self.model).split()))
        ids, counts = np.unique(np.frombuffer(b"".join(found), dtype="uint32"), return_counts=True)
        return ids.astype("int64"), np.log1p(counts)


class Featuriser:
    """``Words`` made once per Python worker from the broadcast character model."""

    def __init__(self, shared, buckets: int):
        self.shared, self.buckets, self.words = shared, buckets, None

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None:
            self.words = Words(self.shared.value, self.buckets)
        return self.words(text)

    def __getstate__(self):
        return {"shared": self.shared, "buckets": self.buckets, "words": None}


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; learns from the labels whose
    ``crc32(doc_id) mod 3`` is not 1."""
    rows = texts(docs, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(count_model(rows))
    featurise: Callable[[str], tuple[np.ndarray, np.ndarray]] = Featuriser(shared, settings.buckets)
    sample = labelled_sample(rows, labels, "toxic", crc_mod("doc_id", 3) != 1, settings)
    model: Model = train(sample, featurise, settings)
    scored = scores(rows, model, featurise)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
