"""Mention extraction: filter documents, split sentences, find ids, classify, blind, one row per id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.functions.text import blind, split_sentences, squeeze, strip_tags
from litmine.operators.rules import LOOSE_ID, PDB, Rule, RulePack

_MARK = "\u0001"


def may_hold_id(text: Column, pack: RulePack = PDB) -> Column:
    """True if the text holds an id of the pack; used on documents and again on sentences."""
    tests = [
        F.contains(text, F.lit(literal)) & text.rlike(pattern) if literal else text.rlike(pattern)
        for literal, pattern in pack.prefilter
    ]
    return reduce(lambda a, b: a | b, tests)


def find_ids(sentence: Column, pack: RulePack = PDB) -> Column:
    """Sorted array of the distinct ids of a sentence."""
    found = F.regexp_extract_all(sentence, F.lit(pack.id_pattern), 0)
    for literal, pattern in pack.extra_ids:
        first = F.regexp_extract(sentence, pattern, 1)
        found = F.concat(
            found, F.when(F.contains(sentence, F.lit(literal)) & (first != ""), F.array(first)).otherwise(F.array())
        )
    if pack.upper:
        # One upper() over the joined ids keeps the expression in generated code; a lambda per id would not.
        found = F.array_remove(F.split(F.upper(F.array_join(found, _MARK)), _MARK), "")
    return F.sort_array(F.array_distinct(found))


def _fires(sentence: Column, rule: Rule) -> Column:
    """A rule looks at its first hit only; with ``unless`` the hit must not contain that pattern."""
    hit = sentence.rlike(rule.pattern)
    if rule.unless:
        hit = F.regexp_extract(sentence, rule.pattern, 0).rlike(f"(?s)^(?!.*{rule.unless}).+")
    if rule.literals:
        hit = reduce(lambda a, b: a | b, [F.contains(sentence, F.lit(x)) for x in rule.literals]) & hit
    return hit


def classify(sentence: Column, pack: RulePack = PDB) -> Column:
    """Name of the first rule that fires, else the default class."""
    chain = F
    for rule in pack.rules:
        chain = chain.when(_fires(sentence, rule), F.lit(rule.name))
    return chain.otherwise(F.lit(pack.default))


def is_positive(match_type: Column, pack: RulePack = PDB) -> Column:
    return match_type != pack.default


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: all other columns plus ``sentence_no`` and ``raw``."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "raw"))


def mentions_of_sentences(sents: DataFrame, pack: RulePack = PDB, id_column: str = "pdb_id") -> DataFrame:
    """Sentences with a column ``raw`` -> one row per (sentence, id)."""
    raw = F.col("raw")
    keep = [c for c in sents.columns if c != "raw"]
    found = sents.filter(may_hold_id(raw, pack)).select(
        *keep,
        find_ids(raw, pack).alias("ids"),
        classify(raw, pack).alias("match_type"),
        squeeze(strip_tags(raw)).alias("sentence"),
    )
    # explode() would make Catalyst add a filter on size(ids) and run the id regex twice per sentence.
    rows = found.select(*keep, F.explode_outer("ids").alias(id_column), "ids", "sentence", "match_type")
    return rows.filter(F.col(id_column).isNotNull()).select(
        *keep,
        id_column,
        "sentence",
        blind(F.col("sentence"), F.col("ids")).alias("blinded_sentence"),
        "match_type",
        is_positive(F.col("match_type"), pack).alias("match"),
    )


def candidate_sentences(files: DataFrame, pack: RulePack = PDB, text: str = "text") -> DataFrame:
    """The sentences with an id in ``raw``, and at least one row per file; ``raw`` is null in a row that only names its file.

    Map-only. With it a choice between files is made after the mining, on these few rows, and no text is shuffled.
    """
    keep = [c for c in files.columns if c != text]
    split = F.when(may_hold_id(F.col(text), pack), split_sentences(F.col(text)))
    rows = files.select(*keep, F.posexplode_outer(split).alias("sentence_no", "raw"))
    rows = rows.withColumn("raw", F.when(may_hold_id(F.col("raw"), pack), F.col("raw")))
    return rows.filter(F.col("raw").isNotNull() | (F.coalesce("sentence_no", F.lit(0)) == 0))


def mine_mentions(docs: DataFrame, pack: RulePack = PDB, id_column: str = "pdb_id") -> DataFrame:
    """Documents ``(file_name, text)`` -> mention records. Map-only: no shuffle, no Python on the row path."""
    kept = docs.filter(may_hold_id(F.col("text"), pack))
    return mentions_of_sentences(sentences(kept), pack, id_column)


def mentions_known(docs: DataFrame, known_ids: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Keys of the documents that hold an id of ``known_ids(pdb_id)`` in the loose shape.

    ``known_ids`` is broadcast by Catalyst only while its measured size is below the session's limit.
    """
    found = docs.select(key, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(LOOSE_ID), 1)).alias("hit"))
    hits = found.select(key, F.upper(F.right("hit", F.lit(4))).alias("pdb_id"))
    return hits.join(known_ids.select("pdb_id"), "pdb_id", "left_semi").select(key).distinct()


def first_format(files: DataFrame, key: str = "file_name", order: tuple[str, ...] = ("format_rank", "archive")) -> DataFrame:
    """Keep one copy per article: the smallest by ``order``, whose columns should tell the copies apart.

    The winner is found by a partial aggregate over the narrow columns, so a name that holds a large share of
    all rows is combined before the shuffle. All columns of ``files`` then meet the winners in a join; to mine whole texts,
    pass ``candidate_sentences`` of them instead of the texts.
    """
    first = files.groupBy(key).agg(F.min(F.struct(*order)).alias("first")).select(key, "first.*")
    return files.join(first, [key, *order], "left_semi")


def since(files: DataFrame, updates: DataFrame, last_updated: str, key: str = "file_name") -> DataFrame:
    """Drop files whose known update date lies before ``last_updated``; files without a date stay."""
    return files.join(before(updates, last_updated, key), key, "left_anti")


def before(updates: DataFrame, last_updated: str, key: str = "file_name") -> DataFrame:
    """Names of the files whose known update date lies before ``last_updated``."""
    return updates.filter(F.col("update_date") < F.to_date(F.lit(last_updated))).select(key)
