"""Registered queries of the operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm import (
    alignment,
    license_scan,
    masked_lm,
    mixing,
    packing,
    periodic,
    pieces,
    quality_classifier,
    quality_rules,
    simhash,
    token_store,
    topk,
    toxicity,
)
from litmine.llm.common import table
from litmine.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.quality_scores(docs, labels)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, str(tokenizer))
    return token_store.digests(spark, path)


def op3_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.filter("vec_id % 20 = 0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path, "ids")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.md5("text").alias("decoded_md5"))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(docs, labels)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.notices(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.repeated_tails(table(spark, sf_dir, "documents"))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, piece_level = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment_scores(table(spark, sf_dir, "documents"), byte_level, piece_level)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_token_store,
        op3_topk_maxscore,
        op4_simhash,
        op5_pieces,
        op6_masked_lm,
        op7_toxicity,
        op8_license_scan,
        op9_quality_rules,
        op10_best_fit_packing,
        op11_mixing,
        op12_periodic_runs,
        op13_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op11_mixing": mixing.ORACLE,
    "op3_topk_maxscore": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))::bigint) as v from embeddings
          where vec_id is not null and embedding is not null
            and list_aggregate(list_transform(embedding, lambda x: x is not null and isfinite(x)), 'bool_and')),
        scored as (
          select q.vec_id as query_id, r.vec_id, list_dot_product(q.v::double[], r.v::double[])::bigint as score
          from v q join v r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id),
        ranked as (
          select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
          from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20""",
}
