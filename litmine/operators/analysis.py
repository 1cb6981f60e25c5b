"""Merging of results, yearly reports and comparison with another provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.operators.labels import union_all

DETAIL_COLUMNS = (
    "pdb_id",
    "match_type",
    "deposition_year",
    "pmc_id",
    "pm_id",
    "publication_year",
    "primary_citation",
    "sentence",
)


def merge_details(positives_i: DataFrame, positives_ii: DataFrame, predicted: DataFrame) -> DataFrame:
    """All accepted mentions, range-sorted; the columns after the two keys only break ties."""
    rows = union_all(*[df.select(*DETAIL_COLUMNS) for df in (positives_i, positives_ii, predicted)])
    return rows.sort("pdb_id", "pmc_id", "match_type", "sentence")


def merge_unique(details: DataFrame) -> DataFrame:
    """Distinct (id, article) pairs with their years."""
    return details.drop("match_type", "sentence").distinct().sort("pdb_id", "pmc_id")


def mentions_by_year(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("publication_year").agg(F.count("*").alias("mentions"))


def mentions_by_type(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("match_type").agg(F.count("*").alias("mentions"))


def mean_mentions(mentions: DataFrame) -> DataFrame:
    """Per year the mean of the rollup counts, subtotals included, and the mean per article without them.

    The row with a null year belongs to the grand total and has no mean per article.
    """
    counts = mentions.rollup("publication_year", "pmc_id").agg(
        F.count("*").alias("n"), F.grouping_id().alias("level")
    )
    return counts.groupBy("publication_year").agg(
        F.avg("n").alias("mean_rollup"),
        F.avg(F.when(F.col("level") == 0, F.col("n"))).alias("mean_per_article"),
    )


def articles_by_year(mentions: DataFrame) -> DataFrame:
    """Articles with a mention per year; an article with more than one year counts in the first."""
    per_article = mentions.groupBy("pmc_id").agg(F.min("publication_year").alias("publication_year"))
    return per_article.groupBy("publication_year").agg(F.count("*").alias("mentions"))


def publications_by_year(articles: DataFrame) -> DataFrame:
    return articles.groupBy("publication_year").agg(F.count("*").alias("publications"))


def mention_ratio(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """Share of a year's publications that hold a mention."""
    joined = publications_by_year(articles).join(articles_by_year(mentions), "publication_year")
    return joined.withColumn("ratio", F.try_divide(F.col("mentions"), F.col("publications")))


def external_in_scope(external: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of the other provider that belong to the mined collection."""
    return external.select("pmc_id").distinct().join(articles.select("pmc_id"), "pmc_id")


def only_ours(mentions: DataFrame, external: DataFrame, articles: DataFrame) -> DataFrame:
    return mentions.select("pmc_id").subtract(external_in_scope(external, articles))


def only_theirs(mentions: DataFrame, external: DataFrame, articles: DataFrame) -> DataFrame:
    return external_in_scope(external, articles).subtract(mentions.select("pmc_id"))


def row_counts(**frames: DataFrame) -> DataFrame:
    """Row counts of several frames in one job."""
    return union_all(*[
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()
    ])
