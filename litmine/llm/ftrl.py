"""Sparse logistic regression trained with follow-the-regularised-leader (proximal) updates.

A row of training data is a label and a sparse vector (bucket ids, values). Training is data parallel: the bounded sample
is dealt into shards, each shard runs the per-coordinate updates over its rows in an order fixed by a hash, and the
weights of the shards are averaged between rounds. The model is one dense float vector whose length is a parameter, so
that its broadcast has a fixed size whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import stored

Featurise = Callable[[str], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are fitted; all else is a setting of the learner."""

    buckets: int = 1 << 18
    sample_rows: int = 12_000
    shards: int = 6
    rounds: int = 3
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1


@dataclass
class Model:
    """``weights`` by bucket and the bias; ``score`` is the logistic of the sparse dot product."""

    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        margin = self.bias + float(np.dot(self.weights[ids], values))
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, margin))))


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, s: Settings) -> np.ndarray:
    """Weights after ``s.epochs`` passes over ``rows``; the last coordinate is the bias and is not shrunk by L1.

    ``start`` are the weights to go on from: the accumulated gradients are set so that the leader is there at first.
    """
    n = np.zeros(len(start))
    z = -start * (s.beta / s.alpha + s.l2)
    z[:-1] -= np.sign(start[:-1]) * s.l1
    bias = len(start) - 1
    for _ in range(s.epochs):
        for label, ids, values in rows:
            i, x = np.append(ids, bias), np.append(values, 1.0)
            l1 = np.full(len(i), s.l1)
            l1[-1] = 0.0
            w = _leader(z[i], n[i], l1, s)
            margin = max(-35.0, min(35.0, float(np.dot(w, x))))
            g = (1.0 / (1.0 + math.exp(-margin)) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    l1 = np.full(len(start), s.l1)
    l1[-1] = 0.0
    return _leader(z, n, l1, s)


def _leader(z: np.ndarray, n: np.ndarray, l1: np.ndarray, s: Settings) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
    w[np.abs(z) <= l1] = 0.0
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable, s: Settings) -> DataFrame:
    """``(doc_id, text, label)`` of a bounded sample of the rows that may be learned from.

    ``learnable`` is a Boolean column over ``doc_id``. Labels are made one per document (the largest, if they differ);
    rows with a null id or label take no part. If there are more than ``sample_rows``, the ids whose hash falls below
    the wanted share are taken, which holds about ``sample_rows`` rows at any size of the input: this bounds the
    broadcast. Texts of repeated ids are reduced to one before they move.
    """
    usable = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    total = usable.count()
    if total > s.sample_rows:
        share = int(s.sample_rows / total * (1 << 30))
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    found = docs.join(F.broadcast(usable), "doc_id").select("doc_id", "text", "label")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(sample: DataFrame, featurise: Featurise, s: Settings) -> Model:
    """Fit on ``(doc_id, text, label)``. Without rows, or with one class only, the model is the smoothed base rate."""
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(s.shards)).cast("int")
    dealt = sample.withColumn("shard", shard).repartition(s.shards * 4, "shard", "doc_id")
    columns = "shard int, doc_id long, label double, ids array<int>, values array<float>"
    rows = stored(dealt.mapInPandas(_featuriser(featurise), columns), "training")
    counts = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = counts["n"], counts["ones"] or 0.0
    base = math.log((ones + 1.0) / (n - ones + 1.0))
    weights = np.zeros(s.buckets + 1)
    weights[-1] = base
    if ones in (0, n):
        return Model(weights[:-1].astype("float32"), base)
    spark = sample.sparkSession
    for _ in range(s.rounds):
        start = spark.sparkContext.broadcast(weights.astype("float32"))
        fitted = rows.groupBy("shard").applyInPandas(_fitter(start, s), "bucket long, weight double, n long")
        mixed = fitted.groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas()  # at most ``buckets`` + 1 rows
        weights = np.zeros(s.buckets + 1)
        weights[mixed["bucket"].to_numpy()] = mixed["weight"].to_numpy() / n
        start.unpersist()
    return Model(weights[:-1].astype("float32"), float(weights[-1]))


def _featuriser(featurise: Featurise):
    """Texts to sparse vectors, once for all rounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [featurise(x) for x in batch["text"]]
            yield batch[["shard", "doc_id", "label"]].assign(ids=[x[0] for x in found], values=[x[1] for x in found])

    return run


def _fitter(start, s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One shard: its weights, times its rows."""

    def fit(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.iloc[np.argsort(pd.util.hash_array(shard["doc_id"].to_numpy()), kind="stable")]
        data = list(zip(shard["label"], shard["ids"], shard["values"]))
        w = ftrl(data, start.value.astype("float64"), s)
        used = np.flatnonzero(w)
        return pd.DataFrame({"bucket": used, "weight": w[used] * len(data), "n": len(data)})

    return fit


def score_of(text: Column, spark: SparkSession, model: Model, featurise: Featurise) -> Column:
    """The score of a text; only the text goes to Python, so no other column can be changed on the way."""
    shared = spark.sparkContext.broadcast(model)

    def run(values: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(*featurise(x.as_py())) for x in values], pa.float64())

    return F.arrow_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def scores(docs: DataFrame, model: Model, featurise: Featurise) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    text = score_of(F.col("text"), docs.sparkSession, model, featurise)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("score"))
