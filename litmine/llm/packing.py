"""Operator 10: best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest permitted length. Pieces are dealt into shards of a bounded number by
a hash, and every shard is packed on its own: pieces in falling order of length go into the open bin they fit best; if
none has room, a bin is opened whose length costs least per token, as estimated from the pieces that are still to come;
in the end every bin is cut down to the shortest permitted length that holds its contents.

Every row has a key of its own in the result, so that rows which share an id, or have none, are told apart; ``sequences``
makes the packed sequences themselves from the same rows with their tokens.

Nulls and edges: a null or negative length counts as 0, which makes one piece of length 0 that shares a bin; null ids are
packed like any other; repeated rows are packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.llm.common import stored, texts

# Permitted lengths, what a sequence costs beside its length, and pieces per shard.
LENGTHS = (256, 512, 1024, 2048)
OVERHEAD = 16
SHARD = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def word_length(text: str = "text") -> Column:
    """Words of a text plus one end mark."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)) + 1


def cheapest(i: int, falling: Sequence[int], rising: Sequence[int], lengths: Sequence[int], overhead: int) -> int:
    """The permitted length with the least cost per token for a bin that is opened by piece ``i`` of ``falling`` and then
    filled greedily with the largest pieces that come after it. ``rising`` is ``falling`` negated, for the search."""
    best, least = lengths[-1], float("inf")
    for length in lengths:
        room, j = length - falling[i], i + 1
        if room < 0:
            continue
        filled = falling[i]
        while room > 0:
            j = bisect_left(rising, -room, j)
            if j >= len(falling):
                break
            room -= falling[j]
            filled += falling[j]
            j += 1
        cost = (length + overhead) / max(filled, 1)
        if cost < least:
            best, least = length, cost
    return best


def best_fit(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD):
    """For each size its bin and place in the bin; for each bin its final length. Ties go to the earlier piece."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    rising = [-x for x in falling]
    room_of: list[int] = []
    opened: list[int] = []
    rooms: list[int] = []  # different rooms of open bins, rising
    by_room: dict[int, list[int]] = {}
    bins = np.empty(len(sizes), dtype="int64")
    places = np.empty(len(sizes), dtype="int64")
    for i, size in enumerate(falling):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            length = cheapest(i, falling, rising, lengths, overhead)
            chosen, room = len(opened), length
            opened.append(length)
            room_of.append(length)
        bins[order[i]] = chosen
        places[order[i]] = opened[chosen] - room
        left = room - size
        room_of[chosen] = left
        if left not in by_room:
            by_room[left] = []
            insort(rooms, left)
        by_room[left].append(chosen)
    used = np.array(opened, dtype="int64") - np.array(room_of, dtype="int64")
    permitted = np.array(lengths, dtype="int64")
    return bins, places, permitted[np.searchsorted(permitted, used)]


def pack(
    items: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD, key: str | None = None
) -> DataFrame:
    """Pack ``items(doc_id, length)``: one row per piece with ``doc_id, row`` (key of the row of ``items``), ``piece, begin``
    (in the document), ``length, bin_id, bin_length, place`` (in the bin). ``key`` names a column of keys (long, no two equal);
    without it they are made here."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    size = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    row = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), size.alias("size"))
    rows = stored(rows, "lengths")
    last = F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col("piece") * longest
    pieces = pieces.select("doc_id", "row", "piece", begin.alias("begin"), F.least(F.col("size") - begin, F.lit(longest)).alias("length"))
    total = rows.agg(F.sum(last + 1)).first()[0] or 0
    shards = max(1, -(-total // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def fill(group: pa.Table) -> pa.Table:  # Arrow: an id stays what it is, beside null ids too
        group = group.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins, places, final = best_fit(group["length"].to_numpy(), lengths, overhead)
        found = group.select(["doc_id", "row", "piece", "begin", "length"])
        found = found.append_column("bin_id", pa.array((group["shard"].to_numpy() << 32) + bins))
        return found.append_column("bin_length", pa.array(final[bins])).append_column("place", pa.array(places))

    columns = "doc_id long, row long, piece long, begin long, length long, bin_id long, bin_length long, place long"
    return pieces.groupBy("shard").applyInArrow(fill, columns)


def packed_documents(docs: DataFrame) -> DataFrame:
    """``pack`` of whole documents measured in words."""
    return pack(texts(docs, "doc_id").select("doc_id", word_length().alias("length")))


def sequences(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """``(bin_id, bin_length, ids)``: the packed sequences of ``tokens(row, ids)``, where ``placed`` is ``pack`` of the same
    rows measured in ids. Every id of every row stands once in one sequence; what is free at the end is not filled. A bin
    holds at most the longest permitted length, so no group is larger."""
    cut = placed.filter("length > 0").join(tokens.select("row", "ids"), "row")
    cut = cut.select("bin_id", "bin_length", "place", F.slice("ids", F.col("begin").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"]))
    return cut.groupBy("bin_id", "bin_length").agg(whole.alias("ids"))
