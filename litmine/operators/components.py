"""Connected components by contraction, links taken both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.session import cut, discard


def _mark(number: int, node: str) -> Column:
    """A node's place in the random order of a round; the node itself breaks ties."""
    return F.struct(F.xxhash64(F.lit(number), F.col(node)).alias("mark"), F.col(node).alias("node"))


def _stars(edges: DataFrame, number: int) -> DataFrame:
    """``(node, center)`` of all nodes but the centers. Each node points to its first neighbour in the round's random order
    unless it comes before all of them itself, which makes it a center: of the nodes of any graph half at most, on average.
    Pointers are followed by doubling; they only lead to earlier nodes, so that chains of them are short."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(_mark(number, "b")).alias("first"))
    stars = cut(first.filter(_mark(number, "a") > F.col("first")).select(F.col("a").alias("node"), F.col("first.node").alias("center")))
    while True:
        further = stars.select(F.col("node").alias("center"), F.col("center").alias("next"))
        moved = F.col("next").isNotNull().alias("moved")
        met = stars.select("node", "center").join(further, "center", "left")
        stars = cut(met.select("node", F.coalesce("next", "center").alias("center"), moved), replaces=stars)
        if stars.filter("moved").isEmpty():
            return stars


def components(edges: DataFrame, each: list[int] | None = None) -> DataFrame:
    """``(id, component)`` of every node of ``edges(src, dst)``; a component is named by its smallest node.

    Every round draws nodes into stars around the centers of a random order and replaces them by the center, so that at
    most half of the nodes with links are left on average: the number of rounds grows with the logarithm of the number
    of nodes and not with the longest path, and all rounds together cost little more than the first. The stars are
    resolved from the last round back. Repeated links, links in both directions and loops are allowed. ``each`` takes the
    number of edges of every round.
    """
    found = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    nodes = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    left = cut(found.filter("src <> dst").select(a.alias("a"), b.alias("b")).distinct())
    rounds = []
    while n := left.count():
        if each is not None:
            each.append(n)
        stars = _stars(left, len(rounds))
        rounds.append(stars)
        moved = left
        for end in ("a", "b"):
            to = stars.select(F.col("node").alias(end), "center")
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce("center", end)).drop("center")
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = cut(moved, replaces=left)
    discard(left)
    if not rounds:
        return nodes.select("id", F.col("id").alias("component"))
    roots = rounds.pop().select("node", F.col("center").alias("root"))
    while rounds:
        stars = rounds.pop()
        later = roots.select(F.col("node").alias("center"), "root")
        here = stars.join(later, "center", "left").select("node", F.coalesce("root", "center").alias("root"))
        roots = cut(here.unionByName(roots), replaces=roots)
        discard(stars)
    smallest = roots.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
    drawn = roots.join(smallest, "root").select(F.col("node").alias("id"), "component")
    known = drawn.unionByName(smallest.select(F.col("root").alias("id"), "component"))
    return nodes.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_of(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all nodes that are connected with a node of ``starts(id)``; a start without links is alone."""
    known = cut(components(edges))
    ids = starts.select("id").filter("id is not null").distinct()
    met = known.join(known.join(ids, "id").select("component").distinct(), "component").select("id", "component")
    return met.unionByName(ids.join(known, "id", "left_anti").select("id", F.col("id").alias("component")))
