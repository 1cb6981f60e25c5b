"""PageRank in two forms and betweenness, as loops of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.operators.graph import Graph
from litmine.operators.spread import EDGES_PER_KEY, BlockedEdges, PlacedEdges, place_blocks, place_edges
from litmine.session import cut, cut_by, discard, grown, union

# Settings of the power method.
TELEPORT = 0.5
MIN_ITER = 50
MAX_ITER = 200
TOLERANCE = 1e-15
ALPHA_STEP = 1e-10

# Settings of the unweighted form.
BASE_RANK = 0.15
DAMPING = 0.85

# Rows (start node, node) that betweenness keeps on disk at a time, about.
STATE_ROWS = 200_000_000


def pagerank(
    graph: Graph,
    alpha: float = TELEPORT,
    min_iter: int = MIN_ITER,
    max_iter: int = MAX_ITER,
    tol: float = TOLERANCE,
    per_key: int = EDGES_PER_KEY,
) -> DataFrame:
    """``(id, pagerank)`` by the power method; ``alpha`` is the probability of teleporting.

    Teleport weight is the node weight (column ``node_weight``, else 1) over its total, dangling mass goes the
    same way. Stops after ``max_iter`` rounds, or after ``min_iter`` once the L1 change is at most ``tol``.

    One round: rank per out-weight meets the edges, which lie in blocks with the places of their ends. What is shuffled is a
    number per block and target, not a row per edge, so much-cited nodes are cheap, and rows by node. The vertex rows are a
    table in buckets by id: they meet the flows where they are. The new state takes the place of the one before; one aggregate over it gives the sum, the
    dangling mass and the change. (An Observation of the write would save that job, but a session that has made one can
    no longer serialise the models of the ML library.)
    """
    edges = cut(graph.simple().edges)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_sum"))
    has_weight = "node_weight" in graph.vertices.columns
    weight = F.when(F.col("node_weight") > 0, F.col("node_weight")).otherwise(1.0) if has_weight else F.lit(1.0)
    nodes = cut(graph.vertices.select("id", weight.alias("node_weight")).join(out, "id", "left"))
    total = nodes.agg(
        F.count("*").alias("n"),
        F.sum("node_weight").alias("weight"),
        F.sum(F.when(F.col("out_sum").isNull(), 1)).alias("dangling"),
    ).first()
    if not total["n"]:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    placed = place_blocks(edges, per_key)
    begun = F.lit(1.0 / total["n"])
    teleport = (F.col("node_weight") / total["weight"]).alias("teleport")
    rows = nodes.select("id", teleport, "out_sum", begun.alias("before"), begun.alias("rank"))
    state = cut_by(rows.repartition(placed.parts, "id"), "id", placed.parts)
    dangling, norm, change = (total["dangling"] or 0) / total["n"], 1.0, 1.0
    for done in range(1, max_iter + 1):
        new = _pagerank_round(state, placed, norm, alpha, dangling)
        state = cut_by(new, "id", placed.parts, replaces=state)
        seen = state.agg(
            F.sum("rank").alias("norm"),
            F.sum(F.when(F.col("out_sum").isNull(), F.col("rank"))).alias("dangling"),
            F.sum(F.abs(F.col("rank") - F.col("before"))).alias("change"),
        ).first()
        norm, last = seen["norm"], change
        dangling, change = (seen["dangling"] or 0.0) / norm, seen["change"]
        if change == last and change > tol:  # within the limit equal changes are rounding, and no sign of a cycle
            alpha += ALPHA_STEP
        if done >= min_iter and change <= tol:
            break
    placed.release()
    discard(nodes)
    return state.select("id", (F.col("rank") / norm).alias("pagerank"))


def _pagerank_round(state: DataFrame, placed: PlacedEdges | BlockedEdges, norm: float, alpha: float, dangling: float) -> DataFrame:
    """The next state, its ranks not yet divided by their sum. ``norm`` is the sum of the ranks of ``state``."""
    rank, beta = F.col("rank") / norm, 1.0 - alpha
    push = state.filter(F.col("out_sum").isNotNull()).select(
        F.col("id").alias("src"), (rank / F.col("out_sum")).alias("share")
    )
    flows = placed.flows(push)
    new = (alpha + beta * dangling) * F.col("teleport") + beta * F.coalesce("flow", F.lit(0.0))
    here = state.select("id", "teleport", "out_sum", rank.alias("before"))
    return here.join(flows, "id", "left").select("id", "teleport", "out_sum", "before", new.alias("rank"))


def pagerank_simple(edges: DataFrame, iterations: int, per_key: int = EDGES_PER_KEY, every: int = 5) -> DataFrame:
    """``(id, rank)`` after a fixed number of rounds of ``0.15 + 0.85 * sum`` on distinct edges.

    All sources start with 1.0; a node without an incoming share has no rank in the next round.
    """
    pairs = cut(edges.select("src", "dst").distinct().withColumn("weight", F.lit(1.0)))
    out = cut(pairs.groupBy("src").agg(F.count("*").alias("n")))
    placed = place_edges(pairs, "src", "dst", per_key)
    ranks, before = out.select(F.col("src").alias("id"), F.lit(1.0).alias("rank")), None
    for done in range(1, iterations + 1):
        push = ranks.withColumnRenamed("id", "src").join(out, "src").select("src", (F.col("rank") / F.col("n")).alias("share"))
        flows = placed.flows(push)
        ranks = flows.select("id", (BASE_RANK + DAMPING * F.col("flow")).alias("rank"))
        if done % every == 0 or done == iterations:
            before = ranks = cut(ranks, replaces=before)
    placed.release()
    return ranks


def top_ranked(ranks: DataFrame, pm_ids: DataFrame, above: float = 0.8) -> DataFrame:
    """Nodes above a rank, with their PubMed id."""
    return ranks.filter(F.col("rank") > above).join(pm_ids.select("id", "pubmed_id"), "id")


def _twins(edges: DataFrame, end: str, other: str) -> DataFrame:
    """``(id, rep)`` of the nodes that have links on the side ``end`` only: ``rep`` is the smallest such node with the very same
    neighbours. Neighbours are told by a count and two hashes that combine, never by a list."""
    alone = edges.select(F.col(end).alias("id")).distinct().join(edges.select(F.col(other).alias("id")).distinct(), "id", "left_anti")
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), F.col(other))).alias(f"h{k}") for k in (1, 2)]
    marks = edges.join(alone.withColumnRenamed("id", end), end).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"), *hashes)
    marks = cut(marks)
    reps = marks.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    return cut(marks.join(reps, ["n", "h1", "h2"]).select("id", "rep"))


def betweenness(graph: Graph, sources: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """``(id, betweenness)`` of the directed, unweighted graph.

    ``sources(id)`` limits the start nodes; without it all nodes start and the result is exact. All start nodes run in one
    loop over rows (source, node): one join per level forward to count shortest paths, one per level backward to add up
    dependencies. Papers that nobody cites and that cite the very same papers start once for all of them, and papers
    that cite nothing and are cited by the very same papers are one target for all of them; neither lies between others, so
    this is exact. ``chunk`` bounds the rows on disk to about nodes x chunk by taking the start nodes in portions; without
    it a portion makes about ``STATE_ROWS`` of them.
    """
    edges = cut(graph.edges.select("src", "dst").filter("src <> dst").distinct())
    heads = _twins(edges, "src", "dst")
    edges = cut(edges.join(heads.filter("id <> rep").select(F.col("id").alias("src")), "src", "left_anti"), replaces=edges)
    tails = _twins(edges, "dst", "src")
    kept = edges.join(tails.filter("id <> rep").select(F.col("id").alias("dst")), "dst", "left_anti")
    times = tails.groupBy(F.col("rep").alias("dst")).agg(F.count("*").alias("times"))
    kept = cut(kept.join(times, "dst", "left").select("src", "dst", F.coalesce("times", F.lit(1)).alias("times")), replaces=edges)
    forward = place_edges(kept.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v", "w")
    backward = place_edges(kept.select(F.col("src").alias("v"), F.col("dst").alias("w"), "times"), "w", "v")
    starts = (graph.vertices if sources is None else sources).select("id").distinct().join(heads, "id", "left")
    starts = starts.groupBy(F.coalesce("rep", "id").alias("id")).agg(F.count("*").alias("times"))
    starts = cut(starts.join(kept.select(F.col("src").alias("id")).distinct(), "id", "left_semi"))
    chunk = chunk or max(1, STATE_ROWS // max(1, graph.vertices.count()))
    n_chunks = max(1, -(-starts.count() // chunk))
    part = F.pmod(F.xxhash64("id"), F.lit(n_chunks))
    total = None
    for c in range(n_chunks):
        made: list[DataFrame] = []
        found = _dependencies(forward, backward, starts.filter(part == c) if n_chunks > 1 else starts, made)
        if found is not None:
            total = cut(found if total is None else _sums(total.unionByName(found)), replaces=total)
        for stored in made:
            discard(stored)
    forward.release()
    backward.release()
    ids = graph.vertices.select("id")
    if total is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    return ids.join(total, "id", "left").select("id", F.coalesce("delta", F.lit(0.0)).alias("betweenness"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sum("delta").alias("delta"))


def _dependencies(forward: PlacedEdges, backward: PlacedEdges, starts: DataFrame, made: list[DataFrame]) -> DataFrame | None:
    """Sum over the start nodes, each taken ``times``, of the dependency of each other node, as ``(id, delta)``. ``made`` gets
    the levels that are stored on the way."""
    level = cut(starts.select(F.col("id").alias("source"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
    made.append(level)
    levels, seen = [level], [level.select("source", "v")]
    while True:
        reached = forward.meet(level).groupBy("source", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        level = cut(reached.join(union(seen), ["source", "v"], "left_anti"))
        made.append(level)
        if level.isEmpty():
            break
        levels.append(level)
        seen = grown([*seen, level.select("source", "v")])
        made.extend(seen[:1])  # the pieces of earlier levels, if they are stored as one
    if len(levels) < 3:
        return None  # no node lies between two others
    parts = []
    rows = levels[-1].select("source", F.col("v").alias("w"), "paths", F.lit(0.0).alias("delta"))
    for level in reversed(levels[1:-1]):
        gain = (F.col("times") + F.col("delta")) / F.col("paths")
        gained = backward.meet(rows).groupBy("source", "v").agg(F.sum(gain).alias("gain"))
        here = cut(
            level.join(gained, ["source", "v"], "left").select(
                "source", "v", "paths", (F.col("paths") * F.coalesce("gain", F.lit(0.0))).alias("delta")
            )
        )
        made.append(here)
        parts.append(here.filter("delta > 0").select("source", F.col("v").alias("id"), "delta"))
        rows = here.withColumnRenamed("v", "w")
    of = starts.select(F.col("id").alias("source"), "times")
    return _sums(union(parts).join(of, "source").select("id", (F.col("delta") * F.col("times")).alias("delta")))
