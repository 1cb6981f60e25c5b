"""Joining mentions to metadata and weak-supervision labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.session import cut

LABEL_COLUMNS = (
    "pdb_id",
    "match_type",
    "deposition_year",
    "pmc_id",
    "pm_id",
    "publication_year",
    "primary_citation",
    "sentence",
    "blinded_sentence",
    "label",
)

POSITIVES_I = "positives_i"
POSITIVES_II = "positives_ii"
NEGATIVES_I = "negatives_i"
NEGATIVES_II = "negatives_ii"
UNASSIGNED = "unassigned"

# Column of rows that stand for several equal ones: how many.
COPIES = "copies"


def copies(df: DataFrame) -> Column:
    """How many rows each row stands for: one without the column ``copies``."""
    return F.col(COPIES) if COPIES in df.columns else F.lit(1).cast("bigint")


def publications(files: DataFrame, articles: DataFrame) -> DataFrame:
    """File metadata with the publication year of the article."""
    return files.select("pmc_id", "pm_id", "file_name").join(
        articles.select("pmc_id", "publication_year"), "pmc_id"
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def _meta(*entries: DataFrame) -> DataFrame:
    return union_all(*entries).select(
        "pdb_id",
        F.col("pmc_id").alias("entry_pmc_id"),
        F.col("pm_id").alias("entry_pm_id"),
        "deposition_year",
        "entry_type",
    )


def merge_metadata(mentions: DataFrame, pubs: DataFrame, *entries: DataFrame) -> DataFrame:
    """Mentions of known articles with the entry metadata; unknown ids keep a null ``entry_type``.

    ``primary_citation`` needs an entry with a PMC id: an equal PubMed id alone does not count.
    """
    # Narrow sides first: a mention row is joined with its two metadata rows and nothing else. The number of parts is named,
    # as an id with many entries makes many rows: parts merged by the size of what they read would be few and large.
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = mentions.join(pubs, "file_name").repartition(parts, "pdb_id")
    meta = _meta(*entries)
    primary = F.col("entry_pmc_id").isNotNull() & (
        (F.col("entry_pmc_id") == F.col("pmc_id")) | (F.col("entry_pm_id") == F.col("pm_id"))
    )
    return placed.join(meta, "pdb_id", "left").select(
        "pdb_id",
        "sentence",
        "blinded_sentence",
        "match_type",
        "pmc_id",
        "pm_id",
        "publication_year",
        "deposition_year",
        "entry_type",
        F.when(primary, F.lit(True)).otherwise(F.lit(False)).alias("primary_citation"),
    )


def set_name(default_class: str = "PDB_NONE") -> Column:
    """The label set of a merged row. The five sets are disjoint; rows with unknown years are in none."""
    primary, known = F.col("primary_citation"), F.col("entry_type").isNotNull()
    not_before = F.col("publication_year") >= F.col("deposition_year")
    return (
        F.when(~known, NEGATIVES_II)
        .when(F.col("publication_year") < F.col("deposition_year"), NEGATIVES_I)
        .when(not_before & primary, POSITIVES_I)
        .when(not_before & (F.col("match_type") != default_class), POSITIVES_II)
        .when(not_before, UNASSIGNED)
    )


def label_mentions(merged: DataFrame, default_class: str = "PDB_NONE") -> DataFrame:
    """All five label sets in one pass: ``set_name`` plus the label columns."""
    return _named(merged, default_class).select("set_name", *LABEL_COLUMNS)


def _named(merged: DataFrame, default_class: str) -> DataFrame:
    named = merged.withColumn("set_name", set_name(default_class)).filter(F.col("set_name").isNotNull())
    return named.withColumn("label", F.when(F.col("set_name").startswith("positives"), 1.0).otherwise(0.0))


def count_labelled(mentions: DataFrame, pubs: DataFrame, *entries: DataFrame, default_class: str = "PDB_NONE") -> DataFrame:
    """The rows of ``label_mentions(merge_metadata(...))`` without the year of the entry, equal ones as one row with their
    number in ``copies``: at most four per mention, however many entries share an id.

    Only the order of the two years and the match of the article tell the set. So entries are counted by id and order of the
    years, for each id and year of a mention; mentions meet these counts as if none were a primary citation. Those that are
    one are found by joins on the id and the article, added to their set and taken from the other one.
    """
    placed = cut(mentions.join(pubs, "file_name").select(
        "pdb_id", "sentence", "blinded_sentence", "match_type", "pmc_id", "pm_id", "publication_year"
    ))
    meta = _meta(*entries).withColumn("entry_type", F.when(F.col("entry_type").isNotNull(), 1))
    n = F.count("*").alias(COPIES)
    years = meta.groupBy("pdb_id", "deposition_year", "entry_type").agg(n)
    before = (F.col("publication_year") < F.col("deposition_year")).alias("before")
    met = placed.select("pdb_id", "publication_year").distinct().join(years, "pdb_id")
    met = met.groupBy("pdb_id", "publication_year", "entry_type", before).agg(
        F.min("deposition_year").alias("deposition_year"), F.sum(COPIES).alias(COPIES)
    )  # any year of a group stands for all of them
    met = met.select(F.col("pdb_id").alias("id"), F.col("publication_year").alias("year"), "entry_type", "deposition_year", COPIES)
    here = F.col("pdb_id").eqNullSafe(F.col("id")) & F.col("publication_year").eqNullSafe(F.col("year"))
    every = placed.join(met, here, "left").drop("id", "year")
    every = every.withColumns({"primary_citation": F.lit(False), COPIES: F.coalesce(COPIES, F.lit(1))})
    linked = meta.filter(F.col("entry_pmc_id").isNotNull()).groupBy(*meta.columns).agg(n)
    linked = linked.withColumnRenamed("pdb_id", "entry_id")
    same_id = F.col("pdb_id") == F.col("entry_id")
    by_article = placed.join(linked, same_id & (F.col("pmc_id") == F.col("entry_pmc_id")))
    by_paper = placed.join(linked, same_id & (F.col("pm_id") == F.col("entry_pm_id")))
    by_paper = by_paper.filter(~F.col("pmc_id").eqNullSafe(F.col("entry_pmc_id")))
    primary = by_article.unionByName(by_paper).withColumn("primary_citation", F.lit(True))
    taken = primary.withColumns({"primary_citation": F.lit(False), COPIES: -F.col(COPIES)})
    rows = union_all(*[df.select(*every.columns) for df in (every, primary, taken)])
    keys = ["set_name", *[c for c in LABEL_COLUMNS if c != "deposition_year"]]
    return _named(rows, default_class).groupBy(*keys).agg(F.sum(COPIES).alias(COPIES)).filter(F.col(COPIES) > 0)


def beyond(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL of counted rows: what ``left`` has more often than ``right``, counted."""
    rows = left.unionByName(right.withColumn(COPIES, -F.col(COPIES)))
    return rows.groupBy(*[c for c in left.columns if c != COPIES]).agg(F.sum(COPIES).alias(COPIES)).filter(F.col(COPIES) > 0)


def label_set(labelled: DataFrame, *names: str) -> DataFrame:
    """One or more of the label sets, without the set name."""
    return labelled.filter(F.col("set_name").isin(*names)).drop("set_name")


# Files that a task may have open at once; more folders than that and it sorts its rows.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_label_sets(labelled: DataFrame, path: str) -> None:
    """One folder per label set. The sets are five, so a task keeps a file of each open and does not sort its rows by set."""
    conf = labelled.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, "8")
    try:
        labelled.write.mode("overwrite").partitionBy("set_name").parquet(path)
    finally:
        conf.set(WRITERS, before)


# Id-shaped words that are no ids.
EXCLUDED_IDS = ("3DNA", "1AND")
EXCLUDED_ENDING = "H2O"


def drop_excluded(df: DataFrame, id_column: str = "pdb_id") -> DataFrame:
    ids = F.col(id_column)
    return df.filter(~ids.isin(*EXCLUDED_IDS) & ~ids.endswith(EXCLUDED_ENDING))


def primary_training_set(labelled: DataFrame) -> DataFrame:
    """Primary citations against other structured mentions whose sentence is not about a deposition."""
    about_deposition = F.contains(F.col("sentence"), F.lit("deposited")) | F.contains(
        F.col("sentence"), F.lit("submitted")
    )
    rows = label_set(labelled, POSITIVES_I).unionByName(
        label_set(labelled, POSITIVES_II).filter(~about_deposition)
    )
    return rows.withColumn("label", F.col("primary_citation").cast("double")).drop("primary_citation")


def mention_training_set(labelled: DataFrame) -> DataFrame:
    """Positives and negatives of the mention classifier without the excluded ids."""
    return drop_excluded(label_set(labelled, POSITIVES_I, POSITIVES_II, NEGATIVES_I, NEGATIVES_II))
