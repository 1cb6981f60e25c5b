"""Operator 11: mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that depends on their ids and texts only, gone through up to
``most`` times. A packet of a queue finishes at a virtual time: the words of its source up to its end, over the source's
target. All packets are range-sorted by that time, and the mix is what comes before the budget is spent; at every place of
that order the sources stand in the ratio of their targets, so a shorter mix is a prefix of a longer one.

A document is one packet unless it is longer than a thousandth (``packets``) of its source's target; then it is cut into
packets of that size, so that a long document does not keep its source far off its target. Only the last document that a
source gives, and the packet at which the budget ends, can be taken in part.

Targets: the sources share ``share`` times all words by weight, but none gets more than ``most`` times its own words; what
is over goes to the others by weight. With the sources sorted by the share at which they are full, that level is the
greatest of (budget less the full ones before) / (weights from here on), so prefix sums give it without iteration.

Running sums in a global order: rows are range-partitioned and sorted, each task adds up its own part, and the sums of the
parts before come from a table of one row per part and source. No source, however large, is in one task.

Nulls and edges: a null or empty text has size 0 and is taken 0 times; a null source is a source, the last one; null ids
are kept; equal rows are a document each and share the order's place, so which of them is taken is not told apart; other
columns are ignored; an empty table gives no rows; if there are no words, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.llm.common import stored
from litmine.operators.numbering import number_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
PACKETS = 1_000

WORD = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, order: Sequence[str], sums: Sequence[str], by: str | None = None) -> DataFrame:
    """Adds ``<name>_run`` for each long column of ``sums``: its sum over the rows up to this one in the given order, of the
    same ``by`` if that is given, which then comes first in ``order``. The order should be total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, "int64")
            first = np.r_[True, group[1:] != group[:-1]]
            at = np.flatnonzero(first)[np.cumsum(first) - 1]  # where the row's group begins in this batch
            out = []
            for name in sums:
                total = np.cumsum(batch.column(name).to_numpy())
                within = total - np.r_[0, total][at]
                if last is not None and group[0] == last:
                    within[at == 0] += carried[name]
                carried[name] = int(within[-1])
                out.append(pa.array(within))
            last = group[-1]
            columns = [*batch.columns, *out, pa.array(np.full(batch.num_rows, part, "int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"{s}_run" for s in sums), "part"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    schema = ", ".join([*fields, *(f"{s}_run long" for s in sums), "part int"])
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "running")
    keys = ["part", by] if by else ["part"]
    totals = placed.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    window = (Window.partitionBy(by) if by else Window).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part and group; a group has at most one per part.
    before = totals.select(*keys, *[F.coalesce(F.sum(s).over(window), F.lit(0)).alias(f"{s}_before") for s in sums])
    met = placed.join(stored(before, "offsets"), keys)
    return met.select(*rows.columns, *[(F.col(f"{s}_run") + F.col(f"{s}_before")).alias(f"{s}_run") for s in sums])


def source_targets(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``(source, no, source_size, weight, target)`` of the sources of ``rows(source, size)``, on shared storage."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    cycle = F.array(*map(F.lit, weights))
    sources = number_rows(sizes, "last", "source", name="no").select(
        "source", "no", "source_size", F.get(cycle, ((F.col("no") - 1) % len(weights)).cast("int")).cast("long").alias("weight"),
        (most * F.col("source_size")).alias("cap"),
    )
    sources = sources.withColumn("full", F.col("cap") / F.col("weight"))
    summed = stored(running(sources, ["full", "no"], ["cap", "weight"]), "sources")
    total, weight = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    left = F.lit(budget) - (F.col("cap_run") - F.col("cap"))
    level = summed.agg(F.max(left / (F.lit(weight) - (F.col("weight_run") - F.col("weight"))))).first()[0] or 0.0
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return stored(summed.select("source", "no", "source_size", "weight", target.alias("target")), "targets")


def shuffle_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of a hash of id and text: the same in every run and for every partitioning."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    packets: int = PACKETS,
    source: str = "source",
) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target`` (its source's) and ``taken``, the words that the mix takes."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", F.col(source).alias("source"), size.alias("size"), shuffle_key().alias("at"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = source_targets(rows, weights, share, most)
    met = rows.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    queue = met.filter("size > 0").select("no", "at", "doc_id", "row", "size", "source_size", "target")
    queue = running(queue, ["no", "at", "doc_id", "row"], ["size"], by="no").withColumn("start", F.col("size_run") - F.col("size"))

    packet = F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / packets))
    whole = queue.withColumn("packet", packet).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    cut = whole.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("packet")) - 1)))
    begin = F.col("i") * F.col("packet")
    cut = cut.withColumn("length", F.least(F.col("packet"), F.col("size") - begin))
    cut = cut.withColumn("end", F.col("epoch") * F.col("source_size") + F.col("start") + begin + F.col("length"))
    cut = cut.select("row", "no", "length", "end", (F.col("end") / F.col("target")).alias("finish"))

    budget = int(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    sent = running(cut, ["finish", "no", "end"], ["length"])
    room = F.lit(budget) - (F.col("length_run") - F.col("length"))
    taken = sent.select("row", F.least("length", room).alias("taken")).filter("taken > 0")
    taken = taken.groupBy("row").agg(F.sum("taken").alias("taken"))
    return met.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


ORACLE = r"""
    with rows as (
      select doc_id, source, substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15) as h,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, row_number() over () as nr
      from documents),
    sizes as (select source, sum(size)::bigint as source_size from rows group by source),
    numbered as (
      select *, row_number() over (order by source is null, source) as no from sizes),
    weighed as (
      select *, [5, 2, 1][1 + (no - 1) % 3] as weight, 2 * source_size as cap from numbered),
    summed as (
      select *, sum(cap) over w - cap as cap_before, sum(weight) over (order by cap / weight, no) - weight as weight_before
      from weighed window w as (order by cap / weight, no)),
    level as (
      select max((1.5::double * (select sum(source_size) from sizes)::double - cap_before)::double
        / ((select sum(weight) from weighed) - weight_before)::double) as level from summed),
    targets as (select source, no, source_size, least(cap::double, level * weight) as target from summed, level),
    queue as (
      select r.*, no, source_size, target,
        sum(size) over (partition by no order by h, doc_id nulls first, nr) - size as start
      from rows r join targets t on r.source is not distinct from t.source),
    packed as (select *, greatest(1, floor(target / 1000))::bigint as packet from queue where size > 0),
    pieces as (
      select *, unnest(range(0, (size + packet - 1) // packet)) as i from packed),
    twice as (select *, unnest([0, 1]) as epoch from pieces),
    ended as (
      select nr, no, least(packet, size - i * packet) as length,
        (epoch * source_size + start + i * packet + least(packet, size - i * packet))::bigint as "end", target from twice),
    sent as (
      select nr, length, sum(length) over (order by "end"::double / target, no, "end") - length as before from ended),
    taken as (
      select nr, sum(greatest(0, least(length, (3 * (select sum(source_size) from sizes)) // 2 - before))) as taken
      from sent group by nr)
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
    from queue left join taken using (nr)"""
