"""Explicit schemas of inputs and intermediate frames. Every outside id is a string, graph ids are bigint."""

from __future__ import annotations

from pyspark.sql import types as T

# Codes of the entry types.
CURRENT = 1
OBSOLETE = 2
UNRELEASED = 3
UNASSIGNED = 4
CURRENT_MODEL = 5
OBSOLETE_MODEL = 6


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

DOCUMENTS = _struct(file_name=_S, text=_S)
ARCHIVE_ENTRIES = _struct(archive=_S, entry_name=_S, file_name=_S, format=_S, text=_S)

MENTIONS = _struct(
    pdb_id=_S,
    file_name=_S,
    sentence=_S,
    blinded_sentence=_S,
    match_type=_S,
    match=T.BooleanType(),
)

FILES = _struct(pmc_id=_S, pm_id=_S, file_name=_S, update_date=T.DateType())
ARTICLES = _struct(journal=_S, publication_year=_I, pmc_id=_S)
ENTRIES = _struct(
    pdb_id=_S, pmc_id=_S, pm_id=_S, deposition_year=_I, deposition_date=T.DateType(), entry_type=_I
)

LINK_SETS = _struct(pubmed_id=_L, cited_in=T.ArrayType(_L), refs=T.ArrayType(_L))
PAPERS = _struct(pubmed_id=_L, title=_S, pub_year=_I, journal=_S, journal_id=_S, last_author=_S)
