"""Citation graphs: building, slicing, labels, degrees, summary, cleaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.functions.text import shorten
from litmine.operators.numbering import number_rows
from litmine.session import cut


@dataclass(frozen=True)
class Graph:
    """``vertices(id, ...)`` and ``edges(src, dst, weight)``; an edge goes from the citing to the cited node."""

    vertices: DataFrame
    edges: DataFrame
    is_simple: bool = False

    def simple(self) -> "Graph":
        """One edge per ordered pair. Of repeated edges the largest weight stays."""
        if self.is_simple:
            return self
        edges = self.edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        return Graph(self.vertices, edges, is_simple=True)

    def stored(self) -> "Graph":
        """The same graph on shared storage, for operators that read it many times."""
        return Graph(cut(self.vertices), cut(self.edges), self.is_simple)


def explode_links(link_sets: DataFrame) -> DataFrame:
    """``(pubmed_id, cited_in)`` -> one row ``(src = citing, dst = cited)`` per link."""
    return link_sets.select(F.explode("cited_in").alias("src"), F.col("pubmed_id").alias("dst"))


def in_years(papers: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Papers of the years ``start`` to ``end``; without both bounds all papers."""
    return papers.filter(F.col("pub_year").between(start, end)) if start > 0 and end > 0 else papers


def build_paper_graph(papers: DataFrame, links: DataFrame, start: int = 0, end: int = 0) -> Graph:
    """Papers of a year window and the links between them; repeated links stay."""
    chosen = in_years(papers, start, end)
    ids = chosen.select("pubmed_id")
    edges = (
        links.select("src", "dst")
        .join(ids.withColumnRenamed("pubmed_id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("pubmed_id", "dst"), "dst", "left_semi")
        .select("src", "dst", F.lit(1.0).alias("weight"))
    )
    return Graph(chosen.withColumnRenamed("pubmed_id", "id"), edges)


def link_check(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Unknown cited papers, links lost with an unknown citing paper, and kept links, in one row."""
    cited = papers.select(F.col("pubmed_id").alias("dst"), F.lit(1).alias("dst_known"))
    citing = papers.select(F.col("pubmed_id").alias("src"), F.lit(1).alias("src_known"))
    # Link counts per pair first: repeated links need no second look-up.
    pairs = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    looked = pairs.join(cited, "dst", "left").join(citing, "src", "left")
    dst_ok, src_ok = F.col("dst_known").isNotNull(), F.col("src_known").isNotNull()

    def links_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    return looked.agg(
        F.count_distinct(F.when(~dst_ok, F.col("dst"))).alias("missing_nodes"),
        links_where(dst_ok & ~src_ok).alias("missing_links"),
        links_where(dst_ok & src_ok).alias("kept_links"),
    )


def build_journal_graph(paper_graph: Graph) -> Graph:
    """Papers of one journal become one node; the weight counts the paper links. All journals stay."""
    papers = paper_graph.vertices
    vertices = papers.groupBy(F.col("journal_id").alias("id")).agg(F.min("journal").alias("name"))
    # Count links per paper pair before the look-ups, then per journal pair.
    pairs = paper_graph.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    src = papers.select(F.col("id").alias("src"), F.col("journal_id").alias("src_journal"))
    dst = papers.select(F.col("id").alias("dst"), F.col("journal_id").alias("dst_journal"))
    edges = (
        pairs.join(src, "src")
        .join(dst, "dst")
        .groupBy(F.col("src_journal").alias("src"), F.col("dst_journal").alias("dst"))
        .agg(F.sum("n").cast("double").alias("weight"))
    )
    return Graph(vertices, edges)


def _slices(windows: list[tuple[str, int, int]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col("pub_year").between(a, b), F.lit(name)) for name, a, b in windows])
    )


def slice_edges(papers: DataFrame, links: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Edges of the paper graph of every year window ``(slice, start, end)`` in one pass.

    Each paper carries the names of its windows; a link belongs to the windows that both ends share.
    """
    member = papers.select("pubmed_id", _slices(windows).alias("slices")).filter(F.size("slices") > 0)
    src = member.select(F.col("pubmed_id").alias("src"), F.col("slices").alias("src_slices"))
    dst = member.select(F.col("pubmed_id").alias("dst"), F.col("slices").alias("dst_slices"))
    return (
        links.select("src", "dst")
        .join(src, "src")
        .join(dst, "dst")
        .select(F.explode(F.array_intersect("src_slices", "dst_slices")).alias("slice"), "src", "dst")
    )


def slice_papers(papers: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    return papers.select(F.explode(_slices(windows)).alias("slice"), "*")


# Longest title and journal name in a node label.
PAPER_TITLE_LIMIT = 300
PAPER_JOURNAL_LIMIT = 100
JOURNAL_NAME_LIMIT = 400


def paper_label() -> Column:
    """``title || id || year || journal || journal id`` with long parts cut."""
    return F.concat_ws(
        " || ",
        shorten(F.col("title"), PAPER_TITLE_LIMIT),
        F.col("id").cast("string"),
        F.substring(F.col("pub_year").cast("string"), 1, 4),
        shorten(F.col("journal"), PAPER_JOURNAL_LIMIT),
        F.col("journal_id"),
    )


def journal_label() -> Column:
    return F.concat_ws(" || ", shorten(F.col("name"), JOURNAL_NAME_LIMIT), F.col("id"))


def light_graph(paper_graph: Graph) -> Graph:
    """The node name is the paper id only."""
    return Graph(
        paper_graph.vertices.select("id", F.col("id").cast("string").alias("name")), paper_graph.edges
    )


def degrees(graph: Graph) -> DataFrame:
    """``(id, in_degree, out_degree, in_weight, out_weight)`` for every vertex; degrees count distinct neighbours.

    Both ends of an edge and the vertices go into one aggregate, so there is one shuffle and hot nodes are
    combined before it.
    """
    w = F.col("weight")
    ends = graph.simple().edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0.0).alias("iw"), w.alias("ow")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), w.alias("iw"), F.lit(0.0).alias("ow")),
            )
        )
    )
    nodes = graph.vertices.select("id", *[F.lit(0).alias(c) for c in ("i", "o")], *[F.lit(0.0).alias(c) for c in ("iw", "ow")])
    return (
        ends.unionByName(nodes)
        .groupBy("id")
        .agg(
            F.sum("i").alias("in_degree"),
            F.sum("o").alias("out_degree"),
            F.sum("iw").alias("in_weight"),
            F.sum("ow").alias("out_weight"),
        )
    )


def isolated_count(graph: Graph) -> DataFrame:
    alone = (F.col("in_degree") == 0) & (F.col("out_degree") == 0)
    return degrees(graph).agg(
        F.count("*").alias("nodes"), F.sum(alone.cast("int")).cast("bigint").alias("isolated")
    )


def summary(graph: Graph) -> DataFrame:
    """Eleven figures of the graph in one row.

    ``reciprocal_links`` counts ordered links whose reverse exists, self links included; it groups edges by
    their unordered pair instead of joining the edges with themselves. Weights are summed as whole numbers.
    """
    g = graph.simple()
    no_in, no_out = F.col("in_degree") == 0, F.col("out_degree") == 0

    def count(cond: Column) -> Column:
        return F.sum(cond.cast("int")).cast("bigint")

    nodes = degrees(g).agg(
        count(no_in).alias("no_in"),
        count(no_out).alias("no_out"),
        count(no_in & no_out).alias("no_in_no_out"),
        count(~no_in & ~no_out).alias("in_and_out"),
        F.sum("out_degree").alias("total_out"),
        F.sum("in_degree").alias("total_in"),
        F.count("*").alias("nodes"),
    )
    pairs = g.edges.groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(F.count("*").alias("directions"), F.sum(F.floor("weight")).alias("w"))
    self_link = F.col("a") == F.col("b")
    zero = F.lit(0).cast("bigint")
    links = pairs.agg(
        F.coalesce(count(self_link), zero).alias("self_links"),
        F.coalesce(F.sum(F.when(self_link, F.col("w"))), zero).alias("self_link_weight"),
        F.coalesce(
            F.sum(F.when(self_link, 1).when(F.col("directions") == 2, 2).otherwise(0)), zero
        ).cast("bigint").alias("reciprocal_links"),
        F.coalesce(F.sum("w"), zero).alias("total_in_weight"),
    )
    both = nodes.unionByName(links, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _ends(edges: DataFrame) -> DataFrame:
    """``(id, in_weight, out_weight)`` of the nodes that have an edge."""
    w, zero = F.col("weight"), F.lit(0.0)
    rows = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), zero.alias("iw"), w.alias("ow")),
                F.struct(F.col("dst").alias("id"), w.alias("iw"), zero.alias("ow")),
            )
        )
    )
    return rows.groupBy("id").agg(F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"))


def _peel(edges: DataFrame) -> DataFrame:
    """Without the nodes that lack in-weight or out-weight, all judged on the same state."""
    keep = _ends(edges).filter((F.col("in_weight") >= 1) & (F.col("out_weight") >= 1)).select("id")
    left = edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
    return left.join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


# Ids of the four large journals without one field that are left out of the clean graph.
HUB_JOURNALS = ("0410462", "0404511", "7505876", "101285081")


def clean_graph(graph: Graph, hubs: tuple[str, ...] = HUB_JOURNALS, rounds: int | None = 1) -> Graph:
    """Without hubs, self links, and nodes that do not both give and get links; isolated nodes go last.

    ``rounds=1`` judges the nodes once; ``rounds=None`` repeats until no edge goes. Either does not depend
    on an order of nodes. A node without edges never stays, so the rounds need the edges only.
    """
    def named(column: str) -> Column:
        return F.col(column).cast("string").isin(*hubs)

    edges = graph.simple().edges.filter((F.col("src") != F.col("dst")) & ~named("src") & ~named("dst"))
    edges = cut(edges.select("src", "dst", "weight"))
    size, done = None, 0
    while done != rounds:
        edges, done = cut(_peel(edges), replaces=edges), done + 1
        if rounds is None:
            before, size = size, edges.count()
            if size == before:
                break
    linked = _ends(edges).select("id")
    return Graph(graph.vertices.join(linked, "id", "left_semi"), edges, is_simple=True)


def number_vertices(graph: Graph) -> Graph:
    """Dense node numbers ``node_no`` = 1..n in the order of the ids; edges carry the numbers."""
    vertices = number_rows(graph.vertices, "id", name="node_no")
    ids = vertices.select("id", "node_no")
    edges = (
        graph.edges.join(ids.select(F.col("id").alias("src"), F.col("node_no").alias("src_no")), "src")
        .join(ids.select(F.col("id").alias("dst"), F.col("node_no").alias("dst_no")), "dst")
        .select(F.col("src_no").alias("src"), F.col("dst_no").alias("dst"), "weight")
    )
    return Graph(vertices, edges)
