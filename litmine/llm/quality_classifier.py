"""Operator 1: quality classifier on hashed word n-grams.

A text is cut into runs of letters and digits and runs of symbols, in lower case. Its features are the tokens and the
pairs of neighbours, hashed into a fixed number of buckets; a pair of equal tokens, with none or one between them, has a
bucket of its own. Values are square roots of the share of the text that a feature has, so
that the length of a text does not matter.

Nulls and edges: a null text is the empty text, which has the score of the bias; rows with a null ``doc_id`` are scored
like any other and are ``held_out`` = false; repeated rows are scored each; other columns are ignored; an empty label
table gives 0.5 for all; an empty document table gives no rows.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import crc_mod, texts
from litmine.llm.ftrl import Model, Settings, labelled_sample, score_of, scores, train

SETTINGS = Settings(alpha=1.0)
THRESHOLD = 0.7

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")
# Pairs of equal tokens, next to each other and with one between them.
_SAME, _SAME_BUT_ONE = np.uint64(1), np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str, buckets: int = SETTINGS.buckets) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids, each once, and their values."""
    tokens = _TOKEN.findall(text.encode("utf-8", "replace").lower())
    if not tokens:
        return np.empty(0, dtype="int64"), np.empty(0)
    h = np.fromiter(map(crc32, tokens), dtype="uint64", count=len(tokens))
    pairs = np.where(h[:-1] == h[1:], _SAME, (h[:-1] * _MIX) ^ (h[1:] + np.uint64(0x51ED27)))
    echoes = np.full(int(np.sum(h[:-2] == h[2:])), _SAME_BUT_ONE)
    ids = np.concatenate([h, pairs, echoes]) * _MIX >> np.uint64(64 - buckets.bit_length() + 1)
    found, counts = np.unique(ids.astype("int64"), return_counts=True)
    return found, np.sqrt(counts / len(tokens))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    """Fit on the labels whose ``crc32(doc_id) mod 4`` is not 2."""
    sample = labelled_sample(texts(docs, "doc_id"), labels, "quality", crc_mod("doc_id", 4) != 2, settings)
    return train(sample, features, settings)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    model = classify(docs, labels, settings)
    scored = scores(docs, model, features)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns, of any type; nothing is shuffled."""
    model = classify(docs, labels, settings)
    return docs.filter(score_of(F.col("text"), docs.sparkSession, model, features) >= THRESHOLD)
