"""Runs of repeated words against a plain search, and the digests against a plain version of their definition."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litmine.llm import periodic, registry
from litmine.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, shortest=12):
    """Every distance over the whole text; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, 2 * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_runs_of_long(words, shortest=12):
    """The same for a text of ten thousands of words: all distances, each as one comparison of arrays."""
    index, found = {}, {}
    ids = np.array([index.setdefault(w, len(index)) for w in words])
    for q in range(1, len(words) // 2 + 1):
        differ = np.r_[-1, np.flatnonzero(ids[q:] != ids[:-q]), len(ids) - q]
        stretch = np.diff(differ) - 1
        for at in np.flatnonzero(stretch >= max(q, shortest - q)):
            found.setdefault((int(differ[at]) + 1, int(stretch[at]) + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_runs_sorted(words):
    found = plain_runs(words) if len(words) < 2000 else plain_runs_of_long(words)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs_sorted(words)
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *longest, sha256(listed.encode()).hexdigest(), sha256(plain_collapse(words, runs)).hexdigest())


def as_lists(runs):
    return [tuple(r) for r in runs.tolist()]


@given(st.lists(st.integers(0, 2), max_size=120))
@settings(max_examples=300, deadline=None)
def test_small_alphabets(numbers):
    words = [b"%d" % x for x in numbers]
    assert as_lists(periodic.runs_of([words])[0]) == plain_runs_sorted(words)


def test_planted_periods_at_all_scales():
    rng = random.Random(3)
    documents = []
    for q in (1, 2, 3, 5, 14, 15, 16, 30, 31, 32, 33, 62, 63, 64, 100, 127, 200, 400, 511, 600):
        for times in (2, 2.4, 5):
            root = [b"%d" % rng.randrange(1 + q) for _ in range(q)]
            lead = [b"x%d" % rng.randrange(40) for _ in range(rng.randrange(50))]
            body = (root * 6)[: int(q * times)]
            documents.append(lead + body + lead[::-1] + body[: q // 2])
    got = periodic.runs_of([*documents, [], [b"one"]])
    for words, runs in zip(documents, got):
        assert as_lists(runs) == plain_runs_sorted(words)
    assert not len(got[-1]) and not len(got[-2])


def test_powers_and_powers_with_flaws():
    a, b = [b"a"] * 300, [b"b"]
    for words in (a * 3, a + b + a, a + b + a[:299] + b + a, (a[:40] + b) * 20, [*a, *b, *b, *a] * 2, a[:50] + (a[:7] + b) * 90):
        assert as_lists(periodic.runs_of([words])[0]) == plain_runs_sorted(words)


def test_fibonacci_and_few_words_in_a_long_text():
    x, y = [b"a"], [b"a", b"b"]
    while len(y) < 1500:
        x, y = y, y + x
    rng = random.Random(1)
    few = [b"%d" % rng.randrange(3) for _ in range(1200)]
    few[300:900] = few[:300] * 2
    for words in (y, few):
        assert as_lists(periodic.runs_of([words])[0]) == plain_runs_sorted(words)


def test_sums_of_squared_differences_are_exact():
    rng = np.random.default_rng(0)
    b, m = 16, 5
    blocks, windows = rng.integers(0, 9, (b, m)), rng.integers(0, 9, (3 * b - 1, m))
    want = np.array([[((blocks[:, j] - windows[i : i + b, j]) ** 2).sum() for j in range(m)] for i in range(2 * b)])
    for prime in periodic.PRIMES:
        assert (periodic.squared_differences(blocks, windows, prime) == want % prime).all()


def test_sums_beyond_one_prime():
    """Two blocks whose squared differences add up to the first prime are not taken for equal."""
    words = np.arange(1, 40_000, dtype="int32")
    words[30_000:30_016] = words[29_969:29_985]
    x, d = periodic.occurrences(words, np.arange(0, 39_000, 16) + 1, 16)
    assert list(zip(x, d)) == [] or all((words[i : i + 16] == words[i + k : i + k + 16]).all() for i, k in zip(x, d))
    x, d = periodic.occurrences(words, np.array([29_969]), 16)
    assert (x.tolist(), d.tolist()) == ([29_969], [31])


ODD = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def test_rows_of_every_kind(spark):
    texts = [None, "", " \n\t ", "one", "again " * 60, "a\x1cb c d " * 9, "x y z " * 3 + "q", ODD, ODD + " " + "tail end " * 40]
    rows = [(i, t, "a", None, "s") for i in (0, 9_007_199_254_740_993, None, 7, 7) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, g string, words string")
    got = periodic.run_digests(periodic.periodic_runs(periodic.repeated_tails(docs)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert periodic.run_digests(periodic.periodic_runs(docs.limit(0))).count() == 0


def test_collapsed_text_and_runs(spark):
    docs = spark.createDataFrame([(1, "go " + "on and " * 8 + "stop")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 16, 2)] and row["collapsed"] == "go on and stop" and row["n_words"] == 18


@pytest.mark.parametrize("most", [400])
def test_query(spark, most):
    rows = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    got = {r[0]: tuple(r) for r in registry.QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    assert got.keys() == rows.keys()
    short = [i for i, t in rows.items() if len((t or "").split()) <= most]
    assert len(short) > 100 and sum(got[i][1] > 0 for i in short) > 5
    for i in short:
        assert got[i] == plain_row(i, rows[i])
