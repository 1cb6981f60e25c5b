"""Co-citation: how many papers cite two papers together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.operators.graph import Graph
from litmine.operators.spread import BLOCK, block_join
from litmine.session import cut


def _citer_classes(refs: DataFrame) -> DataFrame:
    """``(dst, class, citers, size)``: papers with the very same citing papers share a class.

    The set of citing papers is told by its size and two 64-bit hashes that combine on the map side, so a
    paper with any number of citations is never collected. The class is named by its smallest paper.
    """
    src = F.col("src")
    marks = refs.groupBy("dst").agg(
        F.count("*").alias("citers"),
        F.bit_xor(F.xxhash64(src)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), src)).alias("h2"),
    )
    names = marks.groupBy("citers", "h1", "h2").agg(F.min("dst").alias("class"), F.count("*").alias("size"))
    return marks.join(names, ["citers", "h1", "h2"]).select("dst", "class", "citers", "size")


def class_pairs(graph: Graph, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The co-citation graph in compact form: ``(members, pairs)``.

    ``members(dst, class, citers, size)`` and ``pairs(a, b, weight)`` with ``a < b`` two classes. Members of
    one class are co-cited ``citers`` times. Papers with one reference only give no pair.
    """
    refs = graph.simple().edges.select("src", "dst")
    counts = refs.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= 2)
    refs = cut(refs.join(counts.select("src"), "src", "left_semi"))
    members = cut(_citer_classes(refs))
    listed = refs.join(members.filter(F.col("dst") == F.col("class")).select("dst"), "dst", "left_semi")
    # The pairs of a paper with a long list are made by many tasks, and counted there before the shuffle.
    left, right = (listed.select("src", F.col("dst").alias(side)) for side in ("a", "b"))
    pairs = (
        block_join(left, right, ["src"], "a", block)
        .filter(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("weight"))
    )
    return members, pairs


def _rows(a: Column, b: Column, weight: Column) -> Column:
    return F.inline(
        F.array(
            F.struct(a.alias("src"), b.alias("dst"), weight.alias("weight")),
            F.struct(b.alias("src"), a.alias("dst"), weight.alias("weight")),
        )
    )


def cocitation_graph(graph: Graph, block: int = BLOCK) -> Graph:
    """Both directions of every co-cited pair with the number of citing papers; vertices are the papers in a pair."""
    members, pairs = class_pairs(graph, block)
    # A class may hold any number of papers, so its expansion is dealt in blocks of members.
    m = members.select("class", F.col("dst").alias("member"))
    across = block_join(m.select(F.col("class").alias("a"), F.col("member").alias("left")), pairs, ["a"], "left", block)
    across = block_join(m.select(F.col("class").alias("b"), F.col("member").alias("right")), across, ["b"], "right", block)
    across = across.select(_rows(F.col("left"), F.col("right"), F.col("weight").cast("double")))
    twins = members.filter(F.col("size") > 1)
    left, right = (twins.select("class", F.col("dst").alias(side), "citers") for side in ("left", "right"))
    within = (
        block_join(left, right.drop("citers"), ["class"], "left", block)
        .filter(F.col("left") < F.col("right"))
        .select(_rows(F.col("left"), F.col("right"), F.col("citers").cast("double")))
    )
    vertices = graph.vertices.join(members.select(F.col("dst").alias("id")), "id", "left_semi")
    return Graph(vertices, across.unionByName(within))


def cocitation_strength(graph: Graph, block: int = BLOCK) -> DataFrame:
    """Per paper the number of co-cited partners and the sum of weights, from the compact form alone."""
    members, pairs = class_pairs(graph, block)
    size = members.filter(F.col("dst") == F.col("class")).select("class", "size")
    sided = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("class"), F.col("b").alias("other"), F.col("weight")),
                F.struct(F.col("b").alias("class"), F.col("a").alias("other"), F.col("weight")),
            )
        )
    )
    sums = (
        sided.join(size.withColumnRenamed("class", "other"), "other")
        .groupBy("class")
        .agg(F.sum("size").alias("others"), F.sum(F.col("size") * F.col("weight")).alias("weights"))
    )
    zero = F.lit(0)
    return members.join(sums, "class", "left").select(
        F.col("dst").alias("id"),
        (F.coalesce("others", zero) + F.col("size") - 1).alias("partners"),
        (F.coalesce("weights", zero) + (F.col("size") - 1) * F.col("citers")).alias("strength"),
    )
