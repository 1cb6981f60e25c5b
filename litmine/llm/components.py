"""Connected components by alternating large and small stars, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import alone, stored
from litmine.session import discard


def _nearest(pairs: DataFrame) -> DataFrame:
    """``(a, least)``: the smallest partner of each ``a``, by partial minima; stored, so that the join with the pairs is a
    join of two plain tables, whose hot keys adaptive execution can split."""
    return stored(pairs.groupBy("a").agg(F.min("b").alias("least")), "nearest")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.filter("b > a").join(_nearest(both), "a")
    return met.select(F.col("b").alias("a"), F.least("least", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these."""
    near = _nearest(edges)
    met = edges.join(near, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return met.union(near.select("a", F.col("least").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)`` that is not the root: the smallest node that can be reached.

    Loops and repeated edges are allowed. Every round writes its edges to the shared folder, so that a lost executor
    costs a round, and removes what the round before had written; the rounds end when the edges do not change, that is when all
    are links to a root.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "edges")
    state = _state(edges)
    while True:
        before = edges
        edges = alone(lambda: _small_star(stored(_large_star(before).distinct(), "edges")).distinct(), "edges")
        discard(before)
        after = _state(edges)
        if after == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = after
