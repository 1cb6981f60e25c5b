"""Readers of article and identifier metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmine import schemas
from litmine.functions.fields import article_name, header_date, snake_case_columns, timestamp_day
from litmine.functions.text import unquote


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Headers of the two article lists.
ARTICLE_LIST = ["Journal Title", "Year", "Volume", "Issue", "Page", "DOI", "PMCID", "PMID", "Manuscript Id", "Release Date"]
FILE_LIST = ["File", "Article Citation", "Accession ID", "Last Updated (YYYY-MM-DD HH:MM:SS)", "PMID"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet sink; ``mode="append"`` adds a batch."""
    df.write.mode(mode).parquet(path)


def export_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def _headed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(_text_schema(columns)).option("header", True).option("escape", '"').csv(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article list (CSV with header) -> ``journal, publication_year, pmc_id``."""
    raw = _headed_csv(spark, path, ARTICLE_LIST)
    return raw.withColumnsRenamed({"Journal Title": "journal", "Year": "publication_year", "PMCID": "pmc_id"}).select(
        "journal", F.col("publication_year").try_cast("int").alias("publication_year"), "pmc_id"
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File list (CSV with header) -> ``pmc_id, pm_id, file_name, update_date``."""
    raw = _headed_csv(spark, path, FILE_LIST)
    file, _, pmc_id, updated, pm_id = FILE_LIST
    return raw.select(
        F.col(pmc_id).alias("pmc_id"),
        F.col(pm_id).alias("pm_id"),
        article_name(F.col(file)).alias("file_name"),
        timestamp_day(F.col(updated)).alias("update_date"),
    )


def _entries(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.ENTRIES])


def read_current_entries(spark: SparkSession, path: str) -> DataFrame:
    """Report of current entries (quoted CSV, header): rows without a valid date go."""
    raw = spark.read.schema(_text_schema(["id", "pmc", "pubmed", "deposited"])).option("header", True).csv(path)
    clean = raw.select(*[unquote(F.col(c)).alias(c) for c in raw.columns])
    year = F.substring("deposited", 1, 4).try_cast("int")
    dated = clean.filter((F.length("deposited") >= 4) & year.isNotNull())
    return _entries(
        dated.select(
            F.col("id").alias("pdb_id"),
            F.col("pmc").alias("pmc_id"),
            F.col("pubmed").alias("pm_id"),
            year.alias("deposition_year"),
            F.try_to_date("deposited", "yyyy-MM-dd").alias("deposition_date"),
            F.lit(schemas.CURRENT).alias("entry_type"),
        )
    )


def read_unreleased_entries(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``structureId="…"`` and ``initialDepositionDate="…"``; a bad date stays as null."""
    line = F.col("value")
    pdb_id = F.regexp_extract(line, 'structureId="([^"]*)"', 1)
    day = F.try_to_date(F.regexp_extract(line, 'initialDepositionDate="([^"]*)"', 1), "yyyy-MM-dd")
    return _entries(
        spark.read.text(path)
        .filter(pdb_id != "")
        .select(
            pdb_id.alias("pdb_id"),
            F.lit(None).alias("pmc_id"),
            F.lit(None).alias("pm_id"),
            F.year(day).alias("deposition_year"),
            day.alias("deposition_date"),
            F.lit(schemas.UNRELEASED).alias("entry_type"),
        )
    )


def read_header_entries(spark: SparkSession, path: str, entry_type: int = schemas.OBSOLETE) -> DataFrame:
    """Fixed-width header lines: day in columns 50-59, id in 62-66, both from 0. The caller names the entry type."""
    line = F.col("value")
    day = header_date(F.trim(F.substring(line, 51, 9)))
    return _entries(
        spark.read.text(path)
        .filter(line.startswith("HEADER"))
        .select(
            F.upper(F.substring(line, 63, 4)).alias("pdb_id"),
            F.lit(None).alias("pmc_id"),
            F.lit(None).alias("pm_id"),
            F.year(day).alias("deposition_year"),
            day.alias("deposition_date"),
            F.lit(entry_type).alias("entry_type"),
        )
    )


def read_external_mentions(spark: SparkSession, *paths: str) -> DataFrame:
    """Mention lists of another provider: the article id is field 2 of two, else field 1; 6 leading chars go."""
    parts = F.split("value", ",")
    field = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return spark.read.text(list(paths)).select(F.substring(field, 7, 1 << 30).alias("pmc_id"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Tabular report (CSV with header): all columns as text under snake-case names."""
    return snake_case_columns(spark.read.option("header", True).option("escape", '"').csv(path))


def read_id_papers(spark: SparkSession, path: str) -> DataFrame:
    """Id -> PubMed id list (quoted CSV, header starts with PDB): rows without a PubMed id go."""
    raw = spark.read.schema(_text_schema(["pdb_id", "pubmed_id"])).csv(path)
    clean = raw.select(*[unquote(F.col(c)).alias(c) for c in raw.columns])
    return clean.filter(~F.col("pdb_id").startswith("PDB") & F.col("pubmed_id").isNotNull()).select(
        "pdb_id", F.col("pubmed_id").try_cast("bigint").alias("pubmed_id")
    )


# 12 columns of the drug table, of which the name and three (id, similarity) pairs are used.
_DRUG_COLUMNS = ["generic_name", "c1", "c2", "c3", "c4", "c5",
                 "pdb_id_1", "sim_1", "pdb_id_2", "sim_2", "pdb_id_3", "sim_3"]


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_text_schema(_DRUG_COLUMNS)).option("nullValue", "").csv(path)
    pairs = [F.coalesce(c, F.lit("")).alias(c) for c in _DRUG_COLUMNS[6:]]
    return raw.filter(~F.col("generic_name").startswith("Generic")).select("generic_name", *pairs)
