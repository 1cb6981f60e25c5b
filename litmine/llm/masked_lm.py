"""Operator 6: masked pseudo-likelihood of documents under a bidirectional window network.

1. Words are hashed into ids: the ending of a word gives one of ``GROUPS`` groups, the word one of ``SLOTS`` ids of the
   group. The ids of all words of all documents are counted.
2. The most frequent ids are classes of their own, the others fall into the class of their group; the probability of an
   id within its class is its smoothed share of the counts.
3. A network sees the classes of ``SPAN`` words on both sides of a word, but not the word, and predicts its class: one
   embedding per place and class, summed, a tanh layer and a softmax. It is trained in numpy, data parallel: in every
   round each task goes over its share of words of every document, starting from the same parameters, and the parameters
   of the tasks are averaged with their numbers of words as weights.
4. The score of a document is the sum over all its words of the log probability of the class plus that of the id within
   the class: its masked pseudo-log-likelihood.

Counts and training cover all words of all documents and so grow with the input; the count table and the parameters have a fixed size.

Nulls and edges: a null or empty text has no words, score 0 and a null mean; rows with a null id are scored like any
other; repeated rows are counted and scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import stored, texts

GROUPS = 32
SLOTS = 8_192
FREQUENT = 96
CLASSES = FREQUENT + GROUPS
BORDER = CLASSES  # what stands before the first and after the last word
SPAN = 2
HIDDEN = 32
CACHE = 500_000


@dataclass(frozen=True)
class Training:
    """In a round every ``stride``-th word of every document is a target, each round from the next first word, so that
    ``stride`` rounds take every word once."""

    rounds: int = 2
    stride: int = 2
    batch: int = 1_024
    rate: float = 0.05
    seed: int = 5


class _Ids(dict):
    """Ids of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(b".,;:!?") or word
        found = self[word] = crc32(bare[-2:]) % GROUPS * SLOTS + crc32(word) % SLOTS
        return found


_IDS = _Ids()


def word_ids(text: str) -> np.ndarray:
    """Ids of the lower-case words of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(_IDS) > CACHE:
        _IDS.clear()
    return np.fromiter(map(_IDS.__getitem__, words), dtype="int32", count=len(words))


def encoded(docs: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` on shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                ids = [word_ids(x) for x in rows.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "ids"])

    return stored(texts(docs, "doc_id").mapInArrow(run, "doc_id long, ids array<int>"), "word-ids")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and the offsets of its documents."""
    lists = batch.column("ids")
    offsets = lists.offsets.to_numpy().astype("int64")
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def id_counts(rows: DataFrame) -> DataFrame:
    """``(id, n)`` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS * SLOTS, dtype="int64")
        for batch in batches:
            total += np.bincount(_flat(batch)[0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Class of every id and its log probability within the class."""

    classes: np.ndarray
    log_share: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    classes = (FREQUENT + np.arange(len(counts)) // SLOTS).astype("int16")
    often = np.lexsort((np.arange(len(counts)), -counts))[:FREQUENT]
    often = often[counts[often] > 0]
    classes[often] = np.arange(len(often))
    smooth = counts + 1.0
    share = smooth / np.bincount(classes, weights=smooth, minlength=CLASSES)[classes]
    return Vocabulary(classes, np.log(share).astype("float32"))


SHAPES = ((2 * SPAN, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))


ENDS = np.cumsum([int(np.prod(x)) for x in SHAPES])
CELLS = np.arange((CLASSES + 1) * HIDDEN).reshape(CLASSES + 1, HIDDEN)  # of an embedding, by class


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    """Embeddings by place, bias, output weights and output bias as views of one vector."""
    begins = [0, *ENDS[:-1]]
    return [flat[first:end].reshape(shape) for first, end, shape in zip(begins, ENDS, SHAPES)]


def begin(seed: int) -> np.ndarray:
    size = sum(int(np.prod(x)) for x in SHAPES)
    return np.random.default_rng(seed).normal(0, 0.1, size).astype("float32")


def bordered(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes with ``SPAN`` times ``BORDER`` before, between and after documents, and the place of every word in there."""
    at = np.arange(len(classes)) + SPAN * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out = np.full(len(classes) + SPAN * len(offsets), BORDER, dtype="int16")
    out[at] = classes
    return out, at


def contexts(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of the neighbours of the words at the places ``at`` of ``line`` (``bordered``), one row each."""
    return np.stack([line[at + shift] for shift in range(-SPAN, SPAN + 1) if shift], axis=1)


def _forward(parameters: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer, and the logit of every class less the greatest of its row."""
    embed, bias, out, out_bias = unpack(parameters)
    hidden = embed[0].take(context[:, 0], axis=0)
    for i in range(1, 2 * SPAN):
        hidden += embed[i].take(context[:, i], axis=0)
    hidden += bias
    np.tanh(hidden, out=hidden)
    logits = hidden @ out
    logits += out_bias
    logits -= logits.max(axis=1, keepdims=True)
    return hidden, logits


def log_probabilities(parameters: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and log probability of every class."""
    hidden, logits = _forward(parameters, context)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return hidden, logits


def target_log_probability(parameters: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of one class of each row."""
    _, logits = _forward(parameters, context)
    own = logits[np.arange(len(target)), target]
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def learn(parameters: np.ndarray, squares: np.ndarray, context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step with per-parameter rates, in place."""
    n = len(target)
    hidden, wrong = log_probabilities(parameters, context)
    np.exp(wrong, out=wrong)  # from here on the error of every class
    wrong[np.arange(n), target] -= 1.0
    wrong /= n
    gradient = np.zeros_like(parameters)
    g_embed, g_bias, g_out, g_out_bias = unpack(gradient)
    g_out[:] = hidden.T @ wrong
    g_out_bias[:] = wrong.sum(axis=0)
    back = wrong @ unpack(parameters)[2].T
    np.multiply(hidden, hidden, out=hidden)
    back *= np.subtract(1.0, hidden, out=hidden)
    g_bias[:] = back.sum(axis=0)
    values = back.ravel()
    for i in range(2 * SPAN):  # numpy adds up single numbers far faster than rows
        np.add.at(g_embed[i].reshape(-1), CELLS.take(context[:, i], axis=0).ravel(), values)
    squares += gradient * gradient
    parameters -= rate * gradient / (np.sqrt(squares) + 1e-8)


def train(rows: DataFrame, words: Vocabulary, t: Training = Training()) -> np.ndarray:
    """Parameters after all rounds. What a round moves is one parameter vector per task, added up by Spark."""
    parameters = begin(t.seed)
    sc = rows.sparkSession.sparkContext
    shared_words = sc.broadcast(words)
    for turn in range(t.rounds):
        shared = sc.broadcast(parameters)
        cells = "at array<int>, value array<double>, n long"
        trained = rows.select("ids").mapInArrow(_trainer(shared_words, shared, t, turn), cells)
        cells = trained.select(F.explode(F.arrays_zip("at", "value")).alias("cell"), "n")
        mean = cells.groupBy(F.col("cell.at").alias("at")).agg((F.sum(F.col("cell.value") * F.col("n")) / F.sum("n")).alias("value"))
        found = mean.toPandas()  # one row per parameter
        if len(found):
            parameters = np.zeros_like(parameters)
            parameters[found["at"].to_numpy()] = found["value"].to_numpy()
        shared.unpersist()
    return parameters


def targets_of(offsets: np.ndarray, t: Training, turn: int) -> np.ndarray:
    """Places of the words that are targets in a round. Where a batch begins does not matter."""
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.flatnonzero((place + turn) % t.stride == 0)


def _trainer(words, start, t: Training, turn: int):
    """A task's pass over its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = start.value.copy()
        squares = np.full_like(parameters, 1e-4)
        seen = 0
        for batch in batches:
            ids, offsets = _flat(batch)
            classes = words.value.classes[ids]
            line, at = bordered(classes, offsets)
            targets = targets_of(offsets, t, turn)
            for begun in range(0, len(targets), t.batch):
                some = targets[begun : begun + t.batch]
                learn(parameters, squares, contexts(line, at[some]), classes[some], t.rate)
            seen += len(targets)
        if seen:
            cells = [pa.array([x]) for x in (np.arange(len(parameters), dtype="int32"), parameters.astype("float64"))]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([seen])], names=["at", "value", "n"])

    return run


def score(rows: DataFrame, words: Vocabulary, parameters: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` of every row."""
    sc = rows.sparkSession.sparkContext
    shared_words, shared = sc.broadcast(words), sc.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = _flat(batch)
            classes, within = shared_words.value.classes[ids], shared_words.value.log_share[ids]
            line, at = bordered(classes, offsets)
            logp = np.empty(len(ids))
            for begun in range(0, len(ids), 1_024):  # what is made of so many words stays in the processor's cache
                some = slice(begun, begun + 1_024)
                logp[some] = target_log_probability(shared.value, contexts(line, at[some]), classes[some]) + within[some]
            lengths = np.diff(offsets)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            total = np.bincount(doc, weights=logp, minlength=len(lengths))
            columns = [batch.column("doc_id"), pa.array(lengths), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "log_likelihood"])

    scored = rows.mapInArrow(run, "doc_id long, n_words long, log_likelihood double")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.withColumn("mean_log_likelihood", mean)


def pseudo_likelihood(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """Count, train and score the documents of a corpus."""
    rows = encoded(docs)
    found = id_counts(rows).toPandas()  # at most GROUPS * SLOTS rows
    counts = np.zeros(GROUPS * SLOTS, dtype="int64")
    counts[found["id"].to_numpy(dtype="int64")] = found["n"].to_numpy(dtype="int64")
    words = vocabulary(counts)
    return score(rows, words, train(rows, words, training))
