"""From raw documents to packed training sequences: good documents, rules, one of each group of near copies, packing.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's ``docs``. What a
stage stored on its way, and the result of the stage before, are removed then: in the end only the result of the last one is
left in the shared folder. All but the last return the columns of ``docs``. SQL cannot express the trained classifier, so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` holds the result against a plain version.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from litmine.llm.common import alone, table
from litmine.llm.packing import packed_documents
from litmine.llm.quality_classifier import good_documents
from litmine.llm.quality_rules import kept_documents
from litmine.llm.simhash import one_of_each
from litmine.session import discard


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it is trained on the labels of the folder."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by removing frequent lines, without these lines."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; one row of a group without ids."""
    return one_of_each(docs, without_id=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return packed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = alone(partial(stage, spark, before, sf_dir), name.replace(" ", "-"))
        discard(before)  # the given table is not one that was stored here
    return docs
