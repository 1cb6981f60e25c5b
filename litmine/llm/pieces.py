"""Operator 5: SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words that no piece spans (white space begins a word, a line feed is one of its own). The different
words of the whole corpus are encoded once: every word is exploded into its substrings of at most the longest piece's
length, these are equi-joined to the piece table, the edges found are grouped by word, and a higher-order ``aggregate``
folds them into the word's pieces.

Documents are put together from the table of words in two parts. The most frequent words, of a fixed number, are broadcast
with their ids; all other words of a document, each once, meet the table in a shuffle join, and a word that is in there
cannot be a hot key. An Arrow function then writes the ids of every word of a text in its order.

Two folds: for a unigram file Viterbi, which keeps the best score and its last edge for every place; for a BPE file
merging, as its scores are merge ranks and the best-scored path is not the encoding: the cuts of a word are bits, and the
edges are gone through by rank, then by place; an edge that joins just two neighbours at its turn removes the cut between
them. One pass is enough if every piece is reached from its own characters in this way, since no merge then makes room for
one of a better rank. Words with a piece that is not reached so are folded step by step, best edge first. A character that
is no piece is an edge with the ids of its bytes. Words of over ``LONGEST`` characters, whose lattice is not worth the
rows, go to the tokenizer's library by a Pandas function, which gives the same ids.

Nulls and edges: a null or empty text has no ids; null ids of documents are kept; repeated rows are encoded each; other
columns are ignored; an empty table gives no rows. Ids that are not in the file decode to nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from litmine.llm.common import dealt, stored, texts
from litmine.session import discard

SPACE = "▁"
LONGEST = 62
# Words that are broadcast with their ids.
FREQUENT = 200_000
# Words whose lattices one task groups: their edges, some dozen a word, fit its memory and are not spilled to disk.
WORDS_PER_TASK = 25_000
WORD = f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n"
UNIGRAM, BPE = 1, 2


def read_model(path: str) -> sentencepiece_model_pb2.ModelProto:
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def piece_table(spark: SparkSession, model) -> DataFrame:
    """``(piece, id, score)`` of the pieces that stand for text: as many rows as the file has."""
    rows = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def words(text: str) -> Column:
    """The words of a text with the space mark before its first one; none of the empty text."""
    marked = F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(WORD), 0))


def lattice(distinct: DataFrame, pieces: DataFrame, longest: int, byte_ids: int) -> DataFrame:
    """``(word, edges)``: edges from ``begin`` to ``end`` with cost and id; one of an unknown character has no id but
    those of its bytes. The words are placed by a hash first, so that the far more edges do not move, in as many parts as
    keep the edges of one part in memory."""
    n = F.length("word")
    parts = -(-distinct.count() // WORDS_PER_TASK)
    begun = dealt(distinct, "word", at_least=parts).select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("begin"))
    upto = F.least(n, F.col("begin") + longest)
    spans = begun.select("word", "begin", F.explode(F.sequence(F.col("begin") + 1, upto)).alias("end"))
    spans = spans.withColumn("piece", F.expr("substring(word, begin + 1, end - begin)"))
    met = spans.join(F.broadcast(pieces), "piece", "left").filter("id is not null or end = begin + 1")
    as_bytes = F.transform(
        F.regexp_extract_all(F.hex(F.encode("piece", "UTF-8")), F.lit(".."), 0),
        lambda b: F.conv(b, 16, 10).cast("int") + byte_ids,
    )
    edge = F.struct(
        "end", "begin", (-F.coalesce("score", F.lit(1e9))).alias("cost"), "id",
        F.when(F.col("id").isNull(), as_bytes).alias("bytes"),
    )
    return met.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _ids(e: Column) -> Column:
    return F.coalesce(e["bytes"], F.array(e["id"]))


def viterbi(edges: str, unknown_cost: float) -> Column:
    """Ids of the path of least cost; of equal ones the path whose last edges begin first."""
    start = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("begin"), F.array().cast("array<int>").alias("ids")))

    def step(best: Column, e: Column) -> Column:
        total = F.get(best, e["begin"])["total"] + F.when(e["id"].isNull(), F.lit(unknown_cost)).otherwise(e["cost"])
        new = F.struct(total.alias("total"), e["begin"].alias("begin"), _ids(e).alias("ids"))
        last = F.element_at(best, -1)
        fresh = F.size(best) == e["end"]
        return F.when(fresh, F.concat(best, F.array(new))).when(
            total < last["total"], F.concat(F.slice(best, 1, F.size(best) - 1), F.array(new))
        ).otherwise(best)

    def back(path: Column, _: Column) -> Column:
        at = F.get(path["best"], path["at"])
        before = F.struct(
            path["best"].alias("best"), at["begin"].alias("at"), F.concat(at["ids"], path["ids"]).alias("ids")
        )
        return F.when(path["at"] > 0, before).otherwise(path)

    def follow(best: Column) -> Column:
        end = F.struct(best.alias("best"), (F.size(best) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
        return F.aggregate(best, end, back)["ids"]

    return F.aggregate(edges, start, step, follow)


def merges(edges: str, stepwise: Column) -> Column:
    """Ids after merging neighbours, best rank first and left before right, until no two of them make a piece. Where
    ``stepwise`` is true the best edge is looked for anew after every merge."""
    shifted = lambda value, by: F.call_function("shiftleft", F.lit(value).cast("long"), by)
    cut = lambda m, place: m.bitwiseAND(shifted(1, place)) != 0
    whole = F.array_max(F.transform(edges, lambda e: e["end"]))
    start = shifted(2, whole) - 1
    between = lambda e: shifted(1, e["end"]) - shifted(2, e["begin"])
    joins = lambda m, e: cut(m, e["begin"]) & cut(m, e["end"]) & (
        F.bit_count(m.bitwiseAND(e["inner"])) == 1
    )
    several = F.filter(edges, lambda e: e["id"].isNotNull() & (e["end"] > e["begin"] + 1))
    ranked = F.sort_array(
        F.transform(several, lambda e: F.struct(e["cost"], e["begin"], e["end"], between(e).alias("inner")))
    )

    def turn(m: Column, e: Column) -> Column:
        return F.when(joins(m, e), m.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(m)

    def step(m: Column, _: Column) -> Column:
        first = F.get(F.filter(ranked, lambda e: joins(m, e)), F.lit(0))
        return m.bitwiseAND(F.bitwise_not(F.coalesce(first["inner"], F.lit(0).cast("long"))))

    def pieces(m: Column) -> Column:
        chosen = F.filter(
            edges, lambda e: cut(m, e["begin"]) & cut(m, e["end"]) & (m.bitwiseAND(between(e)) == 0)
        )
        return F.flatten(F.transform(chosen, _ids))

    steps = F.aggregate(F.sequence(F.lit(1), whole), start, step, pieces)
    return F.when(stepwise, steps).otherwise(F.aggregate(ranked, start, turn, pieces))


def out_of_order(model) -> list[str]:
    """Pieces that one pass over their own edges, by rank and then by place, does not reach."""
    cost = {p.piece: -p.score for p in model.pieces if p.type in (1, 4)}

    def reached(piece: str) -> bool:
        n = len(piece)
        spans = ((b, e) for b in range(n) for e in range(b + 2, n + 1) if piece[b:e] in cost)
        cuts = set(range(n + 1))
        for b, e in sorted(spans, key=lambda span: (cost[piece[span[0] : span[1]]], span)):
            inner = [place for place in range(b + 1, e) if place in cuts]
            if b in cuts and e in cuts and len(inner) == 1:
                cuts.remove(inner[0])
        return len(cuts) == 2

    return [piece for piece in cost if len(piece) > 1 and not reached(piece)]


def encode_words(distinct: DataFrame, path: str) -> DataFrame:
    """``(word, ids)`` of different words."""
    model = read_model(path)
    pieces = piece_table(distinct.sparkSession, model)
    longest = max(len(p.piece) for p in model.pieces if p.type in (1, 4))
    byte_ids = next((i for i, p in enumerate(model.pieces) if p.type == 6), 0)
    edges = lattice(distinct.filter(F.length("word") <= LONGEST), pieces, longest, byte_ids)
    least = min((p.score for p in model.pieces if p.type == 1), default=0.0)
    if model.trainer_spec.model_type == BPE:
        held = [F.contains("word", F.lit(piece)) for piece in out_of_order(model)]
        fold = merges("edges", reduce(Column.__or__, held, F.lit(False)))
    else:
        fold = viterbi("edges", 10.0 - least)
    short = edges.select("word", fold.alias("ids"))

    def library(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        processor = SentencePieceProcessor(model_file=path)
        for batch in batches:  # a line feed before the word keeps the library from adding a space mark
            ids = [processor.encode("\n" + w.replace(SPACE, " "))[2:] for w in batch["word"]]
            yield batch.assign(ids=ids)

    long = distinct.filter(F.length("word") > LONGEST).mapInPandas(library, "word string, ids array<int>")
    return short.unionByName(long)


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, ids)`` of every row; ``path`` is a model file that every machine has. ``frequent`` bounds the words that
    are broadcast."""
    spark = docs.sparkSession
    rows = stored(texts(docs, "doc_id").withColumn("row", F.monotonically_increasing_id()), "rows")  # one key at every use
    counts = rows.select(F.explode(words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = stored(counts, "word-counts")
    table = stored(encode_words(counts.select("word"), path), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).select("word")
    known = stored(table.join(F.broadcast(top), "word"), "frequent-words")  # at most ``frequent`` rows
    discard(counts)
    common = spark.sparkContext.broadcast({r["word"]: array("i", r["ids"]) for r in known.toLocalIterator()})

    rare = rows.select("row", F.posexplode(F.array_distinct(words("text"))).alias("at", "word"))
    rare = rare.join(F.broadcast(known.select("word")), "word", "left_anti").join(table, "word")
    # A row gets its rare words as their places among its different words: they move to their rows without their text.
    rare = rare.groupBy("row").agg(F.collect_list("at").alias("places"), F.collect_list("ids").alias("word_ids"))
    met = rows.join(rare, "row", "left").select("doc_id", "text", "places", "word_ids")
    split = re.compile(WORD)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = array("i"), [0]
            for text, places, place_ids in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                found = split.findall(SPACE + text.replace(" ", SPACE)) if text else []
                different = list(dict.fromkeys(found)) if places else []
                others = {different[at]: own for at, own in zip(places or (), place_ids or ())}
                for word in found:
                    flat.extend(common.value.get(word) or others[word])
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(np.array(ends, dtype="int32"), np.array(flat, dtype="int32"))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return met.mapInArrow(ids, columns)


def decode(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``(doc_id, text)`` from ``encoded(doc_id, ids)``, and the columns ``keep`` between them. The pieces of a row are
    looked up in its own task: nothing is shuffled or exploded."""
    raw = {i: bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode()
           for i, p in enumerate(read_model(path).pieces) if p.type in (1, 4, 6)}
    known = encoded.sparkSession.sparkContext.broadcast(raw)

    def text(ids: pa.Array) -> pa.Array:
        find = known.value.get
        out = []
        for start in range(0, len(ids), 256):
            rows = (b"".join([find(i, b"") for i in row or ()]) for row in ids.slice(start, 256).to_pylist())
            # without the space mark before the first word
            out.append(pa.array([x.decode("utf-8", "replace").removeprefix(" ") for x in rows], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return encoded.select("doc_id", *keep, F.arrow_udf(text, "string")("ids").alias("text"))
