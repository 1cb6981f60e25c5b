"""Subject tree: links, matching of terms, roll-up of identifier counts, tree as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.functions.fields import tree_parent, tree_path
from litmine.operators.graph import Graph

# The root and the one-letter categories that the descriptor file does not list.
ROOTS = (
    ("ROOT-SCIENCE", "0", "U00"),
    ("Anatomy", "A", "U01"),
    ("Organisms", "B", "U02"),
    ("Diseases", "C", "U03"),
    ("Chemicals and Drugs", "D", "U04"),
    ("Analytical, Diagnostic and Therapeutic Techniques and Equipment", "E", "U05"),
    ("Psychiatry and Psychology", "F", "U06"),
    ("Phenomena and Processes", "G", "U07"),
    ("Disciplines and Occupations", "H", "U08"),
    ("Anthropology, Education, Sociology and Social Phenomena", "I", "U09"),
    ("Technology, Industry, Agriculture", "J", "U010"),
    ("Humanities", "K", "U011"),
    ("Information Science", "L", "U012"),
    ("Named Groups", "M", "U013"),
    ("Health Care", "N", "U014"),
    ("Publication Characteristics", "V", "U015"),
    ("Geographicals", "Z", "U016"),
)


def root_descriptors(spark: SparkSession) -> DataFrame:
    rows = [(ui, mh, [mn], []) for mh, mn, ui in ROOTS]
    return spark.createDataFrame(rows, "ui string, mh string, mns array<string>, terms array<string>")


def tree_links(descriptors: DataFrame) -> DataFrame:
    """``(mn, parent_mn, ui, mh)``: one row per tree number; of a repeated number the last ui by name stays."""
    rows = descriptors.select(F.explode("mns").alias("mn"), "ui", "mh")
    last = rows.groupBy("mn").agg(F.max(F.struct("ui", "mh")).alias("d"))
    return last.select("mn", tree_parent(F.col("mn")).alias("parent_mn"), "d.ui", "d.mh")


def term_index(descriptors: DataFrame) -> DataFrame:
    """``(term, ui)``; a term of several descriptors belongs to the last ui by name."""
    return descriptors.select(F.explode("terms").alias("term"), "ui").groupBy("term").agg(F.max("ui").alias("ui"))


def match_terms(reports: DataFrame, descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pdb_id, ui)`` of the report terms that a descriptor knows, and the counts of found and unknown terms."""
    terms = reports.select("pdb_id", F.explode("terms").alias("term"))
    looked = terms.join(term_index(descriptors), "term", "left")
    found = looked.filter(F.col("ui").isNotNull()).select("pdb_id", "ui").distinct()
    counts = looked.agg(
        F.count("ui").alias("found"), F.sum(F.col("ui").isNull().cast("int")).cast("bigint").alias("not_found")
    )
    return found, counts


def roll_up(assigned: DataFrame) -> DataFrame:
    """``assigned(pdb_id, mn)`` -> per tree node the distinct ids directly on it and on or below it.

    All ancestors are prefixes of the tree number, so one explode takes the place of a walk up the tree.
    Pairs are made distinct before the counts, so the counts need no set in memory.
    """
    path = tree_path(F.col("mn"))
    up = assigned.select("pdb_id", "mn", F.explode(path).alias("node"))
    pairs = up.groupBy("node", "pdb_id").agg(F.max((F.col("node") == F.col("mn")).cast("int")).alias("on_node"))
    return pairs.groupBy(F.col("node").alias("mn")).agg(
        F.sum("on_node").cast("bigint").alias("direct"), F.count("*").alias("cumulative")
    )


def child_counts(links: DataFrame) -> DataFrame:
    """Per tree node the number of children and of all descendants."""
    ancestors = F.filter(tree_path(F.col("mn")), lambda x: x != F.col("mn"))
    below = links.select("parent_mn", F.explode(ancestors).alias("node"))
    return below.groupBy(F.col("node").alias("mn")).agg(
        F.sum((F.col("parent_mn") == F.col("node")).cast("int")).cast("bigint").alias("children"),
        F.count("*").alias("descendants"),
    )


def tree_report(links: DataFrame, assigned_ui: DataFrame) -> DataFrame:
    """Every tree node with direct and cumulative id counts, children and descendants."""
    assigned = links.select("mn", "ui").join(assigned_ui, "ui").select("pdb_id", "mn").distinct()
    zero = F.lit(0).cast("bigint")
    return (
        links.join(roll_up(assigned), "mn", "left")
        .join(child_counts(links), "mn", "left")
        .select(
            "mn",
            "parent_mn",
            "ui",
            "mh",
            *[F.coalesce(c, zero).alias(c) for c in ("direct", "cumulative", "children", "descendants")],
        )
    )


def tree_graph(report: DataFrame) -> Graph:
    """Arcs from child to parent with weight 1; the label shows heading, number and both counts."""
    label = F.format_string('%s [%s] | %d | %d', "mh", "mn", "direct", "cumulative")
    vertices = report.select(F.col("mn").alias("id"), label.alias("name"))
    edges = report.filter(F.col("mn") != "0").select(
        F.col("mn").alias("src"), F.col("parent_mn").alias("dst"), F.lit(1.0).alias("weight")
    )
    return Graph(vertices, edges)
