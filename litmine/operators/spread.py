"""Joins on keys that hold a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmine.session import cut, cut_by, discard

# Rows of the left side per join key in ``block_join``.
BLOCK = 512

# Edges of one node per join key in ``place_edges``.
EDGES_PER_KEY = 50_000

# Edges per kept partition.
MIN_EDGES = 50_000
MAX_EDGES = 10_000_000

# Edges per block in ``place_blocks``, one of which a Python task holds.
BLOCK_EDGES = 1_000_000


def block_join(left: DataFrame, right: DataFrame, keys: list[str], row: str, block: int = BLOCK) -> DataFrame:
    """Inner join on ``keys`` in which a key with many left rows becomes several join keys.

    A key with n left rows gets ceil(n / block) blocks; a left row goes into one block by the hash of
    column ``row``, a right row into all. Size-based skew handling does not see such keys, as their input is
    small and only their output is large.
    """
    many = (
        left.groupBy(*keys)
        .agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        .filter(F.col("blocks") > 1)
    )
    blocks = F.coalesce("blocks", F.lit(1))
    placed = left.join(many, keys, "left").withColumn("k", F.pmod(F.xxhash64(row), blocks).cast("int")).drop("blocks")
    copied = (
        right.join(many, keys, "left").withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    )
    return placed.join(copied, [*keys, "k"]).drop("k")


def _parts(edges: DataFrame, most: int) -> int:
    """Partitions for kept edges: the session's number, fewer for small and more for very large graphs (``most`` edges each)."""
    n = edges.count()
    session = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(session, -(-n // MIN_EDGES)), -(-n // most))


@dataclass(frozen=True)
class PlacedEdges:
    """Edges kept in memory or on disk by their key, for loops that join to them in every round.

    Only the other side of the join moves. ``many`` has the nodes whose edges lie under several keys, at
    most one per ``EDGES_PER_KEY`` edges; it is None if there are none. A frontier stored by the key in as many ``parts``
    (``session.cut_by``) does not move either, unless there are such nodes.
    """

    rows: DataFrame
    key: str
    many: DataFrame | None
    parts: int

    def meet(self, frontier: DataFrame) -> DataFrame:
        """Inner join of ``frontier`` with the edges on the key."""
        if self.many is None:
            return frontier.join(self.rows, self.key)
        keys = F.coalesce("keys", F.lit(1))
        copied = frontier.join(self.many, self.key, "left")
        copied = copied.withColumn("k", F.explode(F.sequence(F.lit(0), keys - 1))).drop("keys")
        return copied.join(self.rows, [self.key, "k"]).drop("k")

    def flows(self, push: DataFrame) -> DataFrame:
        """``(id, flow)``: the sum of ``share * weight`` over the edges ``(src, dst, weight)`` into a node, for ``push(src, share)``."""
        flow = F.sum(F.col("share") * F.col("weight")).alias("flow")
        return self.meet(push).groupBy(F.col("dst").alias("id")).agg(flow)

    def release(self) -> None:
        self.rows.unpersist()


def _many(edges: DataFrame, key: str, per_key: int) -> DataFrame:
    """The nodes with more than ``per_key`` edges, and over how many keys these are spread."""
    counts = edges.groupBy(key).agg(F.ceil(F.count("*") / per_key).cast("int").alias("keys"))
    return cut(counts.filter(F.col("keys") > 1))


def place_edges(edges: DataFrame, key: str, other: str, per_key: int = EDGES_PER_KEY) -> PlacedEdges:
    """Partition and sort edges once by the node in ``key``; a node with very many edges is spread over several keys.

    ``edges`` should be on shared storage, so that lost partitions are cheap to make again.
    """
    parts, many = _parts(edges, MAX_EDGES), _many(edges, key, per_key)
    if many.isEmpty():
        return PlacedEdges(_kept(edges.repartition(parts, key).sortWithinPartitions(key)), key, None, parts)
    k = F.pmod(F.xxhash64(other), F.coalesce("keys", F.lit(1))).cast("int")
    rows = edges.join(many, key, "left").withColumn("k", k).drop("keys").repartition(parts, key, "k")
    return PlacedEdges(_kept(rows.sortWithinPartitions(key, "k")), key, many, parts)


def _kept(rows: DataFrame) -> DataFrame:
    """Kept and made at once: a plan knows how kept rows are placed only after they are there, and shuffles them before."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    return rows


@dataclass(frozen=True)
class BlockedEdges:
    """Weighted edges in blocks by source, for loops that add up a flow along every edge in each round.

    Where an edge begins and ends does not change between rounds, so it is found once, as places in arrays. In a round a
    block adds up what it sends to each part of the targets and gives the sums as one row per block and part, in the order of
    the stored places: the shuffle moves a number per block and target, and no ids. Sums are taken in the order of the blocks,
    so a round gives the same digits each time. ``blocks`` has per block its sources (part -1) and, per part, the place of
    the source and the weight of each edge, and where the edges of the next target begin. ``targets`` has per part its
    ids (block -1) and, per block, the places of the targets. A block holds about ``BLOCK_EDGES`` edges however the
    sources have them, as a node with very many lies in several.
    """

    blocks: DataFrame
    targets: DataFrame
    kind: T.DataType
    many: DataFrame | None
    parts: int

    def sums(self, push: DataFrame) -> DataFrame:
        """``(part, block, sums)``: what each block sends to each part, from ``push(src, share)``."""
        push = push.select("src", "share").filter(F.col("src").isNotNull())
        if self.many is None:
            push = push.withColumn("block", _block(F.lit(0), self.parts))
        else:  # two keys of a node may lie in the same block
            keys = F.sequence(F.lit(0), F.coalesce("keys", F.lit(1)) - 1)
            blocks = F.array_distinct(F.transform(keys, lambda k: _block(k, self.parts)))
            push = push.join(self.many, "src", "left").withColumn("block", F.explode(blocks)).drop("keys")
        pairs = push.groupBy("block").cogroup(self.blocks.groupBy("block"))
        return pairs.applyInPandas(_block_sums, "part int, block int, sums array<double>")

    def flows(self, push: DataFrame) -> DataFrame:
        """``(id, flow)`` as ``PlacedEdges.flows``; a target whose sources push nothing has a flow of zero."""
        pairs = self.sums(push).groupBy("part").cogroup(self.targets.groupBy("part"))
        schema = T.StructType([T.StructField("id", self.kind), T.StructField("flow", T.DoubleType())])
        return pairs.applyInPandas(_part_flows, schema)

    def release(self) -> None:
        for stored in (self.blocks, self.targets, self.many):
            if stored is not None:
                discard(stored)


def _block(k: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col("src"), k), F.lit(parts)).cast("int")


def _block_sums(push: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The sums of one block, from the shares of its sources."""
    rows = block[block["part"] >= 0]
    sums = []
    if len(rows):
        sources = pd.Index(block.loc[block["part"] < 0, "ids"].iloc[0])
        at = sources.get_indexer(push["src"])
        met = at >= 0
        share = np.bincount(at[met], weights=push["share"].to_numpy(float)[met], minlength=len(sources))
        sums = [np.add.reduceat(share[f] * w, b) for f, w, b in zip(rows["at"], rows["weights"], rows["begins"])]
    return pd.DataFrame({"part": rows["part"], "block": rows["block"], "sums": pd.Series(sums, rows.index, dtype=object)})


def _part_flows(sums: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """The flows into the targets of one part, from the sums of all blocks."""
    if part.empty:
        return pd.DataFrame({"id": [], "flow": []})
    ids = part.loc[part["block"] < 0, "ids"].iloc[0]
    flow = np.zeros(len(ids))
    met = sums.merge(part[["block", "at"]], on="block").sort_values("block")
    for values, at in zip(met["sums"], met["at"]):
        flow[at] += values  # a target has one place per block
    return pd.DataFrame({"id": ids, "flow": flow})


def _arrange_block(edges: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``BlockedEdges.blocks`` of one block, with the ids of the targets."""
    edges = edges.sort_values(["part", "dst", "src"])
    sources = pd.Index(np.unique(edges["src"]))
    at = sources.get_indexer(edges["src"]).astype(np.int32)
    weights, targets, parts = (edges[c].to_numpy() for c in ("weight", "dst", "part"))
    block, rows = int(edges["block"].iloc[0]), []
    ends = [*np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)]
    for first, end in zip([0, *ends], ends):
        ids = targets[first:end]
        begins = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1]).astype(np.int32)
        rows.append((block, int(parts[first]), ids[begins], at[first:end], weights[first:end], begins))
    rows.append((block, -1, sources.to_numpy(), None, None, None))
    return pd.DataFrame(rows, columns=["block", "part", "ids", "at", "weights", "begins"])


def _arrange_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``BlockedEdges.targets`` of one part."""
    ids = pd.Index(np.unique(np.concatenate(list(rows["ids"]))))
    places = [ids.get_indexer(found).astype(np.int32) for found in rows["ids"]]
    part = int(rows["part"].iloc[0])
    found = [(part, int(block), None, at) for block, at in zip(rows["block"], places)]
    return pd.DataFrame([*found, (part, -1, ids.to_numpy(), None)], columns=["part", "block", "ids", "at"])


def place_blocks(edges: DataFrame, per_key: int = EDGES_PER_KEY) -> BlockedEdges:
    """Deal the edges ``(src, dst, weight)`` into blocks and find the places of their ends.

    ``edges`` should be on shared storage. An edge without an end meets no node and one without a weight carries nothing.
    """
    parts, many = _parts(edges, BLOCK_EDGES), _many(edges, "src", per_key)
    if many.isEmpty():
        discard(many)
        many, placed = None, edges.withColumn("k", F.lit(0))
    else:
        k = F.pmod(F.xxhash64("dst"), F.coalesce("keys", F.lit(1))).cast("int")
        placed = edges.join(many, "src", "left").withColumn("k", k)
    part = F.pmod(F.xxhash64("dst"), F.lit(parts)).cast("int").alias("part")
    placed = placed.filter("src is not null and dst is not null")
    placed = placed.select(_block(F.col("k"), parts).alias("block"), part, "src", "dst", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))
    kind = edges.schema["dst"].dataType
    ids, places = T.StructField("ids", T.ArrayType(kind)), T.StructField("at", T.ArrayType(T.IntegerType()))
    numbers = [T.StructField(c, T.IntegerType()) for c in ("block", "part")]
    rest = [T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("begins", T.ArrayType(T.IntegerType()))]
    arranged = placed.repartition(parts, "block").groupBy("block").applyInPandas(
        _arrange_block, T.StructType([*numbers, ids, places, *rest])
    )
    blocks = cut_by(arranged, "block", parts)
    found = blocks.filter("part >= 0").select("part", "block", "ids").repartition(parts, "part").groupBy("part")
    targets = cut_by(found.applyInPandas(_arrange_part, T.StructType([*numbers[::-1], ids, places])), "part", parts)
    return BlockedEdges(blocks, targets, kind, many, parts)
