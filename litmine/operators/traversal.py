"""Frontier loops: reachable nodes and the citation cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.operators.spread import PlacedEdges, place_edges
from litmine.session import cut, cut_by, discard, union

# Stored levels that are merged into one, so that a level is not held against ever more tables.
PIECES = 8


def both_ways(edges: DataFrame) -> DataFrame:
    """Every link as a step from either end; repeated links stay."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("dst").alias("next")),
                F.struct(F.col("dst").alias("id"), F.col("src").alias("next")),
            )
        )
    )


def _levels(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """``(id, level)``: all nodes that can be reached, with the number of steps.

    One join per level. The steps are placed once and the reached ids are tables in buckets by id, so only the ids that a
    level names are shuffled.
    """
    placed = place_edges(steps, "id", "next")
    frontier = cut_by(starts.select("id").distinct().withColumn("level", F.lit(0)), "id", placed.parts)
    reached, level = [frontier], 0
    while not frontier.isEmpty():
        level += 1
        frontier = cut_by(_next_level(frontier, placed, reached).withColumn("level", F.lit(level)), "id", placed.parts)
        reached.append(frontier)
        if len(reached) > PIECES:  # the frontier stays a table of its own
            merged = cut_by(union(reached[:-1]), "id", placed.parts)
            for piece in reached[:-1]:
                discard(piece)
            reached = [merged, frontier]
    placed.release()
    return union(reached)


def _next_level(frontier: DataFrame, placed: PlacedEdges, reached: list[DataFrame]) -> DataFrame:
    """``(id)`` one step from the frontier and in none of the tables ``reached``."""
    step = placed.meet(frontier.select("id")).select(F.col("next").alias("id")).distinct()
    for piece in reached:
        step = step.join(piece.select("id"), "id", "left_anti")
    return step


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes connected with a start node, links taken both ways, with their distance."""
    return _levels(starts, cut(both_ways(edges).distinct()))


def citation_closure(seeds: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cascade from seed papers along citing and cited papers until no new paper comes.

    Returns ``papers(id, level, hits)`` and one row of figures per level. ``hits`` counts a paper's seeds
    and its occurrences in the link lists of all papers of the cascade. ``seeds(id)`` may repeat an id.
    """
    steps = both_ways(links)
    flat = cut(steps.groupBy("id", "next").agg(F.count("*").alias("n")))
    levels = cut(_levels(seeds, flat.select("id", "next")))
    seeded = seeds.groupBy("id").agg(F.count("*").alias("seeded"))

    # Per (paper, level that names it) the number of mentions; everything below is an aggregate of it.
    named = (
        flat.join(levels.select("id", "level"), "id")
        .groupBy(F.col("next").alias("id"), F.col("level").alias("at"))
        .agg(F.sum("n").alias("n"))
    )
    named = cut(named.join(levels.select("id", F.col("level").alias("own")), "id"))
    hits = named.groupBy("id").agg(F.sum("n").alias("n"))
    papers = (
        levels.join(seeded, "id", "left")
        .join(hits, "id", "left")
        .select("id", "level", (F.coalesce("seeded", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("hits"))
    )

    # A paper enters a level with the mentions of the level before; seeds enter with their own count.
    first = named.filter(F.col("own") == F.col("at") + 1).select("id", F.col("own").alias("level"), "n")
    entering = first.unionByName(seeded.select("id", F.lit(0).alias("level"), F.col("seeded").alias("n")))
    retrieved = entering.groupBy("level").agg(F.count("*").alias("retrieved"), F.sum("n").alias("retrieved_total"))
    fresh = F.col("own") == F.col("at") + 1
    found = named.groupBy(F.col("at").alias("level")).agg(
        F.sum("n").alias("new_total"),
        F.count("*").alias("new_unique"),
        F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("not_seen_total"),
        F.sum(fresh.cast("int")).cast("bigint").alias("not_seen_unique"),
    )
    figures = retrieved.join(found, "level", "left").na.fill(0)
    return papers, figures
