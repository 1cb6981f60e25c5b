"""Citation links and paper summaries: XML, ``||`` text and plain edge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine import schemas

# Names of the two link lists.
CITED_IN = "pubmed_pubmed_citedin"
REFERENCES = "pubmed_pubmed_refs"
SEP = " || "

_LINK_SET = (
    "IdList struct<Id: array<string>>, "
    "LinkSetDb array<struct<LinkName: string, Link: array<struct<Id: string>>>>"
)
_DOC_SUM = "Id string, Item array<struct<_Name: string, _VALUE: string>>"


def read_link_xml(spark: SparkSession, path: str) -> DataFrame:
    """Link sets -> ``(pubmed_id, cited_in, refs)``."""
    raw = spark.read.schema(_LINK_SET).option("rowTag", "LinkSet").xml(path)

    def linked(name: str) -> Column:
        lists = F.filter(F.coalesce("LinkSetDb", F.array()), lambda db: db["LinkName"] == name)
        return F.flatten(F.transform(lists, lambda db: F.transform(db["Link"], lambda x: x["Id"].try_cast("bigint"))))

    return raw.select(
        F.get("IdList.Id", F.lit(0)).try_cast("bigint").alias("pubmed_id"),
        linked(CITED_IN).alias("cited_in"),
        linked(REFERENCES).alias("refs"),
    ).select(*schemas.LINK_SETS.names)


def read_summary_xml(spark: SparkSession, path: str) -> DataFrame:
    """Paper summaries -> ``(pubmed_id, title, pub_year, journal, journal_id, last_author)``."""
    raw = spark.read.schema(_DOC_SUM).option("rowTag", "DocSum").xml(path)

    def item(name: str) -> Column:
        return F.get(F.filter("Item", lambda x: x["_Name"] == name), F.lit(0))["_VALUE"]

    return raw.select(
        F.col("Id").try_cast("bigint").alias("pubmed_id"),
        item("Title").alias("title"),
        F.substring(item("PubDate"), 1, 4).try_cast("int").alias("pub_year"),
        item("FullJournalName").alias("journal"),
        item("NlmUniqueID").alias("journal_id"),
        item("LastAuthor").alias("last_author"),
    )


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(~F.col("value").startswith("*") & (F.trim("value") != ""))
    return lines.select(F.transform(F.split("value", r"\|\|"), lambda x: F.trim(x)).alias("f"))


def _at(n: int) -> Column:
    return F.get("f", F.lit(n))


def _ids(text: Column) -> Column:
    parts = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).try_cast("bigint"))


def read_link_text(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(
        _at(0).try_cast("bigint").alias("pubmed_id"), _ids(_at(1)).alias("cited_in"), _ids(_at(2)).alias("refs")
    )


def read_summary_text(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(
        _at(0).try_cast("bigint").alias("pubmed_id"),
        _at(1).alias("title"),
        _at(2).try_cast("int").alias("pub_year"),
        _at(3).alias("journal"),
        _at(4).alias("journal_id"),
        _at(5).alias("last_author"),
    )


def write_link_text(link_sets: DataFrame, path: str) -> None:
    """``id || cited-in,... || refs,...``"""
    def joined(name: str) -> Column:
        return F.array_join(F.col(name).cast("array<string>"), ",")

    link_sets.select(
        F.concat_ws(SEP, F.col("pubmed_id").cast("string"), joined("cited_in"), joined("refs")).alias("value")
    ).write.mode("overwrite").text(path)


def write_summary_text(papers: DataFrame, path: str) -> None:
    """``id || title || year || journal || journal id || last author``"""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schemas.PAPERS.names]
    papers.select(F.concat_ws(SEP, *columns).alias("value")).write.mode("overwrite").text(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``src dst`` pairs separated by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.get(parts, F.lit(0)).alias("src"), F.get(parts, F.lit(1)).alias("dst")).distinct()
