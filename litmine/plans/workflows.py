"""The long jobs from files to files: mining, labelling and classification, and citation networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine import schemas
from litmine.operators import analysis, centrality, cocitation, graph, labels, mentions, model, ranking
from litmine.operators.graph import Graph
from litmine.operators.rules import PDB, RulePack
from litmine.session import cut, discard
from litmine.sources import archives, links, metadata, pajek

# Folder names below the working directory.
MENTIONS = "mentions"
LABELS = "label_sets"
PREDICTED = "predicted"
DETAILS = "mention_details"
UNIQUE = "mention_unique"
PRIMARY = "primary_predicted"


def mine_archives(
    spark: SparkSession, archive_folder: str, out: str, files: DataFrame | None = None,
    last_updated: str | None = None, pack: RulePack = PDB,
) -> None:
    """Archives -> mention records. With ``last_updated`` only newer files are mined, and their rows take the place of
    those that an earlier run has left for the same files.

    Archives are read once; the texts of older files are passed over while unpacking. Every copy of an article is mined in
    the same pass, and the choice of a format is made on the sentences found, so no text is shuffled or stored.
    """
    order = ("format_rank", "archive", "entry_name")

    def sentences(entries: DataFrame) -> DataFrame:
        entries = entries.withColumn("format_rank", archives.format_rank())
        return mentions.candidate_sentences(entries.drop("format"), pack)

    if files is None or last_updated is None:
        rows = cut(sentences(archives.read_archives(spark, archive_folder)))
    else:
        rows = archives.read_except(spark, archive_folder, mentions.before(files, last_updated), sentences)
    kept = mentions.first_format(rows, order=order)
    found = mentions.mentions_of_sentences(kept.filter(F.col("raw").isNotNull()).select("file_name", "raw"), pack)
    if last_updated is None:
        metadata.write_table(found, out)
    else:
        metadata.write_table(spark.createDataFrame([], found.schema), out, "ignore")
        others = metadata.read_table(spark, out).join(kept.select("file_name"), "file_name", "left_anti")
        merged = cut(others.unionByName(found))  # stored first, as it reads what it replaces
        metadata.write_table(merged, out)
        discard(merged)
    discard(rows)


def label(spark: SparkSession, work: str, files: DataFrame, articles: DataFrame, *entries: DataFrame) -> None:
    """Mentions and metadata -> the five label sets."""
    found = spark.read.schema(schemas.MENTIONS).parquet(f"{work}/{MENTIONS}")
    merged = labels.merge_metadata(found, labels.publications(files, articles), *entries)
    labels.write_label_sets(labels.label_mentions(merged), f"{work}/{LABELS}")


def _sets(spark: SparkSession, work: str) -> DataFrame:
    return metadata.read_table(spark, f"{work}/{LABELS}")


def train(spark: SparkSession, work: str) -> None:
    """Fit, save and evaluate the mention classifier and the primary-citation classifier."""
    sets = _sets(spark, work)
    for name, rows, tol in (
        ("mention", labels.mention_training_set(sets), model.MENTION_TOL),
        ("primary", labels.primary_training_set(sets), model.PRIMARY_TOL),
    ):
        training, test = model.split(rows, "pdb_id", "pmc_id", "blinded_sentence")
        fitted = model.fit(training, tol=tol)
        model.save(fitted, f"{work}/{name}_model")
        model.write_report(model.evaluate(fitted, training, test), f"{work}/{name}_metrics")


def predict(spark: SparkSession, work: str) -> None:
    """Accepted unassigned mentions, and primary citations as Parquet and as TSV."""
    sets = _sets(spark, work)
    unassigned = labels.label_set(sets, labels.UNASSIGNED)
    chosen = model.predict_mentions(model.load(f"{work}/mention_model"), unassigned)
    metadata.write_table(chosen, f"{work}/{PREDICTED}")
    candidates = labels.label_set(sets, labels.POSITIVES_II, labels.UNASSIGNED)
    metadata.write_table(model.predict_primary(model.load(f"{work}/primary_model"), candidates), f"{work}/{PRIMARY}")
    metadata.export_tsv(metadata.read_table(spark, f"{work}/{PRIMARY}"), f"{work}/{PRIMARY}_tsv")


def merge(spark: SparkSession, work: str) -> None:
    sets = _sets(spark, work)
    details = analysis.merge_details(
        labels.label_set(sets, labels.POSITIVES_I),
        labels.label_set(sets, labels.POSITIVES_II),
        metadata.read_table(spark, f"{work}/{PREDICTED}"),
    )
    metadata.write_table(details, f"{work}/{DETAILS}")
    metadata.write_table(analysis.merge_unique(metadata.read_table(spark, f"{work}/{DETAILS}")), f"{work}/{UNIQUE}")


def analyse(spark: SparkSession, work: str, articles: DataFrame) -> dict[str, DataFrame]:
    """The yearly reports, by name."""
    final = metadata.read_table(spark, f"{work}/{DETAILS}")
    return {
        "mentions_by_year": analysis.mentions_by_year(final),
        "mentions_by_type": analysis.mentions_by_type(final),
        "mean_mentions": analysis.mean_mentions(final),
        "articles_by_year": analysis.articles_by_year(final),
        "publications_by_year": analysis.publications_by_year(articles),
        "mention_ratio": analysis.mention_ratio(final, articles),
    }


def convert_xml(spark: SparkSession, link_xml: str, summary_xml: str, out: str) -> None:
    """Citation and summary XML -> the two ``||`` text files."""
    links.write_link_text(links.read_link_xml(spark, link_xml), f"{out}/links")
    links.write_summary_text(links.read_summary_xml(spark, summary_xml), f"{out}/summaries")


def build_networks(spark: SparkSession, link_text: str, summary_text: str, out: str, start: int = 0, end: int = 0) -> None:
    """Paper and journal networks of a year window as Pajek files."""
    papers = links.read_summary_text(spark, summary_text)
    cites = graph.explode_links(links.read_link_text(spark, link_text))
    paper_graph = graph.build_paper_graph(papers, cites, start, end).stored()
    named = Graph(paper_graph.vertices.withColumn("name", graph.paper_label()), paper_graph.edges)
    pajek.write_network(graph.number_vertices(named), f"{out}/papers.net")
    journals = graph.build_journal_graph(paper_graph)
    named = Graph(journals.vertices.withColumn("name", graph.journal_label()), journals.edges)
    pajek.write_network(graph.number_vertices(named), f"{out}/journals.net")


def cocite(spark: SparkSession, network: str, out: str) -> None:
    found = cocitation.cocitation_graph(pajek.read_network(spark, network)).stored()
    pajek.write_network(graph.number_vertices(found), out, directed=False)


def clean(spark: SparkSession, network: str, out: str, rounds: int | None = 1) -> None:
    """Clean journal network; a node is a hub if its name ends in the id of one."""
    g = pajek.read_network(spark, network)
    hubs = [F.contains("name", F.lit(f"|| {hub}")) for hub in graph.HUB_JOURNALS]
    kept = g.vertices.filter(~(hubs[0] | hubs[1] | hubs[2] | hubs[3]))
    ids = kept.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    cleaned = graph.clean_graph(Graph(kept, edges), (), rounds).stored()
    pajek.write_network(graph.number_vertices(cleaned), out)


def measure(spark: SparkSession, network: str, out: str, alpha: float = centrality.TELEPORT,
            with_betweenness: bool = False) -> None:
    """Degrees, PageRank and, on demand, exact betweenness of a network as a metrics file."""
    g = pajek.read_network(spark, network).simple().stored()
    table = ranking.metrics_table(g, centrality.pagerank(g, alpha)).join(g.vertices.select("id", "name"), "id")
    if with_betweenness:
        table = table.join(centrality.betweenness(g), "id")
    else:
        table = table.withColumn("betweenness", F.lit(0.0))
    pajek.write_metrics(table, out)
