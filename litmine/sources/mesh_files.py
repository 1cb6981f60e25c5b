"""Subject descriptors and reports of ids with subject terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.operators.mesh import root_descriptors

# Two descriptors without a tree number.
_LEFT_OUT = ("Female", "Male")


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """``(ui, mh, mns, terms)`` of all ``*NEWRECORD`` records and the roots.

    Terms are the heading and, of the entry lines with a ``|``, the text before it.
    """
    record = F.col("value")

    def values(tag: str, rest: str = "(.*)") -> Column:
        return F.regexp_extract_all(record, F.lit(rf"(?m)^{tag} = {rest}"), 1)

    heading = F.get(values("MH"), F.lit(0))
    rows = (
        spark.read.option("lineSep", "*NEWRECORD")
        .text(path)
        .select(
            F.get(values("UI"), F.lit(0)).alias("ui"),
            heading.alias("mh"),
            values("MN").alias("mns"),
            F.array_distinct(F.concat(F.array(heading), values("ENTRY", r"([^|\n]*)\|"))).alias("terms"),
        )
        .filter(F.col("ui").isNotNull() & ~F.col("mh").isin(*_LEFT_OUT))
    )
    return rows.unionByName(root_descriptors(spark))


def read_term_report(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV ``id, year, PMC id, PubMed id, terms`` -> ``(pdb_id, pub_year, pmc_id, pm_id, terms)``."""
    raw = spark.read.schema("pdb_id string, pub_year string, pmc_id string, pm_id string, terms string").csv(path)
    terms = F.filter(F.split(F.coalesce("terms", F.lit("")), ", "), lambda x: x != "")
    return raw.filter(~F.col("pdb_id").startswith("PDB")).withColumn("terms", terms)
