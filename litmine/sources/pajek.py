"""Pajek network files and the metrics file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.operators.graph import Graph
from litmine.session import cut

_NODE = r'^\s*(\d+)\s+"(.*)"\s*(\S*)\s*$'
_LINK = r"^\s*(\d+)\s+(\d+)(?:\s+(\S+))?\s*$"
_COUNT = r"(?i)^\s*\*(vertices|arcs|edges)\s+(\d+)"


def _weight(pattern: str) -> Column:
    value = F.regexp_extract("value", pattern, 3).try_cast("double")
    return F.when(value > 0, value).otherwise(1.0)


def read_network(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """``vertices(id, name, node_weight)`` and ``edges(src, dst, weight)``.

    A node line always has a quote and a link line never, so the order of lines does not matter. A missing
    or non-positive weight is 1. Links to unknown nodes go. With ``check`` the counts must match the headers.

    The text is read and taken apart once, into a Parquet copy by kind of line; each use reads its kind and its columns.
    """
    lines = cut(_parsed(spark.read.text(path)), by="kind")
    if check:
        _check_counts(lines, path)
    vertices = lines.filter("kind = 'node'").select(F.col("a").alias("id"), "name", F.col("weight").alias("node_weight"))
    edges = lines.filter("kind = 'link'").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    ids = vertices.select("id")
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return Graph(vertices, known.select("src", "dst", "weight"))


def _parsed(lines: DataFrame) -> DataFrame:
    """``(a, b, name, weight, kind)``: a node's number, name and weight, a link's ends and weight, or a count stated in a
    header; other lines go."""
    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract("value", pattern, group).try_cast("bigint").alias("ab"[group - 1])

    none, no_name = F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("string").alias("name")
    node = F.struct(
        number(_NODE, 1), none, F.regexp_extract("value", _NODE, 2).alias("name"), _weight(_NODE).alias("weight"),
        F.lit("node").alias("kind"),
    )
    link = F.struct(number(_LINK, 1), number(_LINK, 2), no_name, _weight(_LINK).alias("weight"), F.lit("link").alias("kind"))
    stated = F.regexp_extract("value", _COUNT, 2).try_cast("bigint").alias("a")
    head = F.when(F.lower(F.regexp_extract("value", _COUNT, 1)) == "vertices", "nodes_stated").otherwise("links_stated")
    count = F.struct(stated, none, no_name, F.lit(1.0).alias("weight"), head.alias("kind"))
    value = F.col("value")
    row = F.when(value.rlike(_NODE), node).when(value.rlike(_LINK), link).when(value.rlike(_COUNT), count)
    return lines.select(row.alias("row")).filter("row is not null").select("row.*")


def _check_counts(lines: DataFrame, path: str) -> None:
    got = lines.agg(
        F.sum(F.when(F.col("kind") == "nodes_stated", F.col("a"))).alias("nodes_stated"),
        F.sum(F.when(F.col("kind") == "links_stated", F.col("a"))).alias("links_stated"),
        F.count_if(F.col("kind") == "node").alias("nodes"),
        F.count_if(F.col("kind") == "link").alias("links"),
    ).first()
    if (got["nodes_stated"], got["links_stated"]) != (got["nodes"], got["links"]):
        raise ValueError(f"{path}: header and body differ: {got.asDict()}")


def write_network(numbered: Graph, path: str, directed: bool = True) -> None:
    """Write a graph with dense node numbers (``node_no``, ``name``; see ``number_vertices``).

    Lines are range-sorted by section and number, so the part files in order are the network file.
    """
    section = "*Arcs " if directed else "*Edges "
    zero = F.lit(0).cast("bigint")

    def head(df: DataFrame, order: int, text: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(
            F.lit(order).alias("part"), zero.alias("a"), zero.alias("b"),
            F.concat(F.lit(text), F.col("n").cast("string")).alias("value"),
        )

    nodes = numbered.vertices.select(
        F.lit(1).alias("part"), F.col("node_no").alias("a"), zero.alias("b"),
        F.format_string('%d "%s"', "node_no", "name").alias("value"),
    )
    links = numbered.edges.select(
        F.lit(3).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"),
        F.concat_ws(" ", *[F.col(c).cast("string") for c in ("src", "dst", "weight")]).alias("value"),
    )
    rows = head(numbered.vertices, 0, "*Vertices ").unionByName(nodes)
    rows = rows.unionByName(head(numbered.edges, 2, section)).unionByName(links)
    rows.sort("part", "a", "b").select("value").write.mode("overwrite").text(path)


_METRICS = ("id", "in_degree", "out_degree", "pagerank", "betweenness", "name")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``id || inDeg || outDeg || pageRank || betweenness || name``"""
    columns = [F.col(c).cast("string") for c in _METRICS]
    metrics.select(F.concat_ws(" || ", *columns).alias("value")).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The name may hold the separator itself, so only the first five fields are split off."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("*") & (F.trim("value") != ""))
    f = F.split("value", r"\s*\|\|\s*", 6)
    types = ("bigint", "bigint", "bigint", "double", "double", "string")
    return lines.select(*[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(zip(_METRICS, types))])
