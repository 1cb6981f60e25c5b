"""Operator 3: exact top-k search by inner product with MaxScore.

A vector is a document with a term for every component and sign; a posting holds the size of the component. For a query,
the terms whose sign agrees with the query's add to the score, the others take away, so the score of a row is at most
what its agreeing terms add. Postings are columns over all rows of a shard, as each component of a dense vector is in one of its two
postings: so the postings of some queries are traversed together, as a product of the queries' sizes with the columns. Rows are dealt
into shards and queries into blocks; a task has one shard and one block:

1. The threshold of a query starts as the k-th score of a few rows that lead its strongest postings.
2. Its agreeing terms are ordered by their greatest possible part of the score. The weakest, whose parts together stay
   below the threshold, are non-essential: a row that is only in their postings cannot get in.
3. The essential postings are traversed and their parts added up. Rows that could not reach the threshold with all that
   the non-essential terms could add are dropped; of the others the non-essential terms are probed, and those are dropped that
   stay out of reach. What remains is scored exactly.

The best of the shards are merged by rank. Ties go to the smaller id, so rows equal to the threshold are never dropped.

Nulls and edges: vectors that are null or hold a null or non-finite component take no part; vectors of different lengths
are padded with zeros; rows with a null id take no part; repeated rows are rows each, but a query id that is repeated is
asked once, with the first of its vectors; a row is never its own result; other columns are ignored. Components are meant to be small
enough that scores fit a long. No query or no row gives no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmine.llm.common import stored

K = 20
SCALE = 64
SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024

# Queries that traverse the postings together.
TOGETHER = 64

# Below every score.
NONE = int(np.iinfo(np.int64).min)


class Shard:
    """Rows of one shard with postings by component and sign, in rising order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # By component, first of all positive and then of all negative signs.
        self.postings = np.concatenate([np.maximum(self.vectors, 0), np.maximum(-self.vectors, 0)], axis=1).T
        self.greatest = self.postings.max(axis=1)
        count = min(4 * k, len(ids))
        leaders = [np.argpartition(-sizes, count - 1)[:count] for sizes in self.postings]
        self.leaders = np.array(leaders, dtype="int64").reshape(len(leaders), count)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the best ``k`` rows but its own, best first."""
        kind = _exact_kind(queries, self.vectors)
        vectors, postings = self.vectors.astype(kind), np.ascontiguousarray(self.postings.astype(kind))
        sizes = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        for first in range(0, len(queries), TOGETHER):
            some = slice(first, first + TOGETHER)
            yield from self._together(query_ids[some], queries[some].astype(kind), sizes[some], k, vectors, postings)

    def _together(self, query_ids: np.ndarray, queries: np.ndarray, sizes: np.ndarray, k: int, vectors: np.ndarray,
                  postings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bounds = sizes * self.greatest  # what a term can add at most
        order = np.argsort(bounds, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)  # what the weakest terms can add together
        thresholds = np.array([self._threshold(*x, k, vectors) for x in zip(query_ids, queries, order[:, -4:])], dtype="int64")
        weak = (reach < thresholds[:, None]).sum(axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        essential = rank >= weak[:, None]
        spare = np.where(weak > 0, np.take_along_axis(reach, np.maximum(weak - 1, 0)[:, None], axis=1)[:, 0], 0)
        parts = np.where(essential, sizes, 0).astype(queries.dtype) @ postings
        alive = parts >= (thresholds - spare).astype(queries.dtype)[:, None]
        thresholds = thresholds.astype(queries.dtype)
        # Rows that no query of these can get are left out of all that follows.
        rows = np.flatnonzero(alive.any(axis=0))
        parts, alive = parts[:, rows], alive[:, rows]
        parts += np.where(essential, 0, sizes).astype(queries.dtype) @ postings[:, rows]
        alive &= parts >= thresholds[:, None]
        rest = alive.any(axis=0)
        rows, alive = rows[rest], alive[:, rest]
        scores = queries @ vectors[rows].T
        alive &= scores >= thresholds[:, None]
        for query_id, mine, found in zip(query_ids, alive, scores):
            at = np.flatnonzero(mine)
            yield best(self.ids[rows[at]], found[at].astype("int64"), query_id, k)

    def _threshold(self, query_id: int, query: np.ndarray, strongest: np.ndarray, k: int, vectors: np.ndarray) -> int:
        """The k-th best score of some rows: those that stand highest in the strongest postings. The least number there is
        if there are fewer than k, or if the score is not above zero: then even a row without an agreeing term may get in."""
        rows = np.unique(self.leaders[strongest])
        rows = rows[self.ids[rows] != query_id]
        if len(rows) < k:
            return NONE
        scores = vectors[rows] @ query
        found = int(np.partition(scores, len(scores) - k)[len(scores) - k])
        return found if found > 0 else NONE


def _exact_kind(queries: np.ndarray, vectors: np.ndarray) -> str:
    """The fastest type in which no sum of a score can be rounded: all are whole numbers below its limit."""
    greatest = [int(np.abs(x).max(initial=0)) for x in (queries, vectors)]
    most = greatest[0] * greatest[1] * 2 * max(vectors.shape[1], 1)
    return "float32" if most < 1 << 24 else "float64" if most < 1 << 53 else "int64"


def best(ids: np.ndarray, scores: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores but the query's own row, ties to the smaller id."""
    other = ids != query_id
    ids, scores = ids[other], scores[other]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype="int64")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``rows(vec_id, v)`` and ``queries(vec_id, v)`` with whole-number vectors."""
    rows, asked = stored(rows.select("vec_id", "v"), "vectors"), queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked, "queries")
    shards, blocks = -(-max(rows.count(), 1) // shard_rows), -(-max(asked.count(), 1) // block_queries)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    left = rows.withColumn("shard", dealt(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(shard) and len(block):
            width = max(shard["v"].map(len).max(), block["v"].map(len).max(), 1)
            index = Shard(shard["vec_id"].to_numpy(), _matrix(shard["v"], width), k)
            asked = block["vec_id"].to_numpy()
            for query_id, (ids, scores) in zip(asked.tolist(), index.search(asked, _matrix(block["v"], width), k)):
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out, dtype="int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: components as floor(scale * x); rows with a null id, vector or component or a component that is
    not finite are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    return rows.select("vec_id", whole.alias("v"))
