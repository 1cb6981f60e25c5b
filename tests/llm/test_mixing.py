"""Mixing of sources against a plain queue, and what it promises about targets."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from hashlib import md5

import pytest

from litmine.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, no string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain_targets(sizes, share=Fraction(3, 2), most=2):
    """Shares by weight; who is over the limit is set to it and what is left is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, targets = share * sum(sizes.values()), set(order), {}
    while open_:
        level = Fraction(left) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return targets | {s: level * weight[s] for s in open_}
        targets |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return targets


def plain_mix(rows, packets=mixing.PACKETS):
    words = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    targets = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    sent = []
    for no, s in enumerate(order):
        queue = [(md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], n) for n, (i, t, of) in enumerate(rows) if of == s]
        packet, end = max(1, int(targets[s]) // packets), 0
        for _ in range(2):
            for _, n in sorted(queue):
                left = words(rows[n][1])
                while left:
                    part = min(packet, left)
                    end, left = end + part, left - part
                    sent.append((end / float(targets[s]), no, end, part, n))
    budget, taken = 3 * sum(sizes.values()) // 2, [0] * len(rows)
    for *_, part, n in sorted(sent):
        taken[n] += min(part, budget)
        budget -= min(part, budget)
    return [(i, s, words(t), sizes[s], float(targets[s]), k) for (i, t, s), k in zip(rows, taken)]


def text(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


ROWS = [
    *((i, text(i, 7 + i % 5), "hot") for i in range(300)),
    *((1000 + i, text(i, 3), None) for i in range(9)),
    (2000, text(0, 9_000), "long"), (2001, text(1, 20), "long"), (2002, "", "none"), (2003, None, "none"),
    (None, text(5, 4), "small"), (None, text(6, 4), "small"), (2**53 + 1, "a\x1cb c d", "small"), (2004, text(7, 1), ""),
]


@pytest.mark.parametrize("packets", [1_000, 10])
def test_against_a_plain_queue(spark, packets):
    got = [tuple(r) for r in mixing.mix(frame(spark, ROWS), packets=packets).collect()]
    key = lambda r: tuple(map(str, r))
    want = plain_mix(ROWS, packets)
    assert sorted((r[:4] + r[5:] for r in got), key=key) == sorted((r[:4] + r[5:] for r in want), key=key)
    for (*_, a, _), (*_, b, _) in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a == pytest.approx(b, rel=1e-12)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = frame(spark, ROWS)
    rows = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    again = sorted(map(tuple, mixing.mix(docs.repartition(5, "text")).collect()), key=str)
    assert rows == again
    taken, target = defaultdict(int), {}
    for _, source, size, _, goal, took in rows:
        assert 0 <= took <= 2 * size
        taken[source] += took
        target[source] = goal
    assert sum(taken.values()) == 3 * sum(r[2] for r in rows) // 2
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 2 + goal / 500


def test_equal_rows_and_no_words(spark):
    same = frame(spark, [(None, text(1, 10), None)] * 40)
    rows = mixing.mix(same).collect()
    assert sum(r["taken"] for r in rows) == 600 and {r["target"] for r in rows} == {600.0}
    assert sum(r["taken"] not in (10, 20) for r in rows) == 0
    blank = mixing.mix(frame(spark, [(1, " ", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in blank] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix(frame(spark, [])).count() == 0


def test_running_sums_over_many_parts(spark):
    rows = [(i % 3, i * 7919 % 1000, i % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(13)
    got = {(r["g"], r["o"]): r["v_run"] for r in mixing.running(df, ["g", "o"], ["v"], by="g").collect()}
    totals = defaultdict(int)
    for g, o, v in sorted(rows):
        totals[g] += v
        assert got[g, o] == totals[g]
