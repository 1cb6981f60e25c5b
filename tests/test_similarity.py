import math
import random
from itertools import combinations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from litmine.functions.fields import cosine
from litmine.functions.text import STOP_WORDS, content_words
from litmine.operators import similarity
from litmine.operators.spread import block_join as blocks


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def plain_words(text):
    import re

    text = re.sub("<.*?>", " ", text)
    return {w for w in re.sub("[^a-zA-Z]", " ", text).lower().split(" ") if len(w) >= 4 and w not in STOP_WORDS}


def near_copies(seed):
    """Groups of near copies with words that most documents share, sizes from 4 to 60 words."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}word" for a in "abcde" for b in "fghij" for c in "klmno"]
    texts = []
    for _ in range(12):
        base = rng.sample(words, rng.randrange(4, 60)) + ["license", "terms"]
        for _ in range(rng.randrange(1, 6)):
            changed = [w for w in base if rng.random() > 0.04]
            texts.append(" ".join(changed + rng.sample(words, rng.randrange(0, 3))))
    return texts + texts[:7] + ["", "the and of"]


def test_words(spark):
    text = "The <b>Quick</b> brown-FOX isn't <i\n> KelvinKelvin cafés were jumping1over over"
    got = docs(spark, [text]).select(content_words(F.col("text")).alias("w")).first()["w"]
    assert sorted(got) == sorted(plain_words(text))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similar_against_all_pairs(spark, seed):
    texts = near_copies(seed)
    sets = [plain_words(t) for t in texts]
    want = {}
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j]:
            cos = len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j]))
            if cos > 0.9:
                want[i, j] = cos
    members, pairs = similarity.similar_articles(docs(spark, texts), "doc_id", content_words(F.col("text")))
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    cos = {(r["a"], r["b"]): r["cosine"] for r in pairs.collect()}
    got = {}
    for i, j in combinations(sorted(rep), 2):
        a, b = sorted((rep[i], rep[j]))
        if a == b:
            got[i, j] = 1.0
        elif (a, b) in cos:
            got[i, j] = cos[a, b]
    assert got == pytest.approx(want)
    assert similarity.similar_pair_count(members, pairs).first()["pairs"] == len(want)


def test_features(spark):
    rng = random.Random(4)
    texts = [" ".join(f"word{c}{c}" for c in rng.sample("abcdefgh", 4)) + " always present" for _ in range(50)]
    frame = docs(spark, texts)
    features = similarity.hashed_features(F.col("text"), 50)
    sets = [set(r["f"]) for r in frame.select(features.alias("f")).collect()]
    used = sorted(set().union(*sets))
    want = {}
    for i, j in combinations(used, 2):
        both = sum(i in s and j in s for s in sets)
        cos = both / math.sqrt(sum(i in s for s in sets) * sum(j in s for s in sets))
        if cos > 0.6:
            want[i, j] = cos
    got = similarity.feature_similarity(frame, features, 50, 0.6).collect()
    assert {(r["i"], r["j"]): r["cosine"] for r in got} == pytest.approx(want) and want


def test_vectors(spark):
    frame = similarity.article_vectors(docs(spark, ["protein kinase protein very kinase"]))
    values = frame.select(vector_to_array("features").alias("v")).first()["v"]
    assert len(values) == 1000 and sorted(values)[-2:] == [1.0, 1.0] and sum(values) == 2.0


def test_cosine(spark):
    row = spark.sql("select array(1.0D, 1.0D, 0.0D) as a, array(1.0D, 0.0D, 0.0D) as b")
    assert row.select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == pytest.approx(1 / math.sqrt(2))


def lsh_sets(spark, texts):
    return similarity.copy_groups(docs(spark, texts), "doc_id", content_words(F.col("text")))[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_approximate_pairs_are_exact_pairs_and_most_of_them(spark, seed):
    sets = lsh_sets(spark, near_copies(seed)).cache()
    exact = {tuple(r) for r in similarity.similar_sets(sets).collect()}
    found = [tuple(r) for r in similarity.similar_sets_lsh(sets).collect()]
    assert len(found) == len(set(found)) and set(found) <= exact and len(found) >= 0.9 * len(exact) > 0


def test_crowded_bands_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "block_join", lambda *a: blocks(*a, block=4))
    base = [f"word{a}{b}" for a in "abcdefghij" for b in "klmno"]
    texts = [" ".join([*base, *base[:0], f"extra{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"]).replace("word", "wordy") for i in range(60)]
    found = similarity.similar_sets_lsh(lsh_sets(spark, texts)).collect()
    assert len(found) == 60 * 59 // 2


def test_min_hashes(spark):
    family = similarity.hash_family(9)
    rows = [[5], [1, 2, 3], list(range(1000)), [2**31 - 2]]
    got = spark.createDataFrame([(r,) for r in rows], "x array<bigint>").coalesce(1).select(similarity.min_hashes(F.col("x"), 9).alias("h"))
    assert [r["h"] for r in got.collect()] == [[min((a * x + b) % similarity.HASH_PRIME for x in xs) for a, b in family] for xs in rows]


def test_candidates_move_no_set_each(spark, monkeypatch):
    """120 near copies are 7,140 candidates; the check moves each set a few times, not once per candidate."""
    monkeypatch.setattr(similarity, "VERIFY_BLOCK", 50)
    words = [f"w{i:03d}" for i in range(200)]
    rows = [(i, [w for j, w in enumerate(words) if j != i]) for i in range(120)]
    sets = spark.createDataFrame(rows, "rep long, items array<string>")
    moved = []
    real = similarity.cut

    def seen(df, *args, **kwargs):
        found = real(df, *args, **kwargs)
        if found.columns == ["place", "rep"]:
            moved.append(found.count())
        return found

    monkeypatch.setattr(similarity, "cut", seen)
    pairs = [(a, b, 199, 199) for a, b in combinations(range(120), 2)]
    candidates = spark.createDataFrame([*pairs, (None, 1, 199, 199)], "a long, b long, n_a int, n_b int")
    got = similarity._verified(candidates, sets, 0.9).collect()
    assert sorted((r["a"], r["b"], r["common"]) for r in got) == [(a, b, 198) for a, b, _, _ in pairs]
    assert sum(moved) <= 120 * 2 * 3 * 2
    twice = similarity._verified(candidates, sets.unionByName(sets), 0.9)  # a set that is there twice is met twice
    assert twice.count() == 4 * len(pairs)
    assert similarity._verified(candidates.limit(0), sets, 0.9).count() == 0


def test_large_sets_that_share_rare_words_are_no_candidates(spark, monkeypatch):
    """40 sets of 900 words of 3,000, of which one pair is near: only a few of the 780 pairs are checked on whole sets."""
    rng = random.Random(7)
    words = [f"w{i:04d}" for i in range(3000)]
    sets = [sorted(rng.sample(words, 900)) for _ in range(39)]
    sets.append(sorted(sets[0][5:]))
    frame = spark.createDataFrame(list(enumerate(sets)), "rep long, items array<string>")
    seen = []
    real = similarity._verified
    monkeypatch.setattr(similarity, "_verified", lambda c, *a: seen.append(c.count()) or real(c, *a))
    assert [(r["a"], r["b"], r["common"]) for r in similarity.similar_sets(frame).collect()] == [(0, 39, 895)]
    assert 1 <= seen[0] <= 5


@pytest.mark.parametrize("most", [1, 1000])
def test_crowded_heads_lose_no_pair(spark, monkeypatch, most):
    """Items that all sets have, in blocks of a few sets and on a table so small that different items share a place."""
    monkeypatch.setattr(similarity, "JOIN_BLOCK", 4)
    monkeypatch.setattr(similarity, "TALLIES", 8 if most == 1 else 1 << 12)
    rng = random.Random(most)
    words = [f"w{i:02d}" for i in range(24)]
    sets = sorted({tuple(sorted(rng.sample(words, rng.randrange(14, 22)))) for _ in range(90)})
    want = {(a, b) for (a, x), (b, y) in combinations(enumerate(sets), 2) if len({*x} & {*y}) / math.sqrt(len(x) * len(y)) > 0.9}
    frame = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "rep long, items array<string>").repartition(3)
    got = [(r["a"], r["b"]) for r in similarity.similar_sets(frame).collect()]
    assert len(got) == len(want) > 30 and set(got) == want


def test_rows_compared_as_tables(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(20, 60, 500))
    at, last = rng.integers(1, 12, 500), np.searchsorted(size, size / 0.81, "right")
    marks = np.zeros((500, 2), dtype=np.uint64)
    want = {
        (i, j) for i in range(500) for j in range(i + 1, last[i])
        if min(at[i], at[j]) + min(size[i] - at[i], size[j] - at[j]) >= 0.9 * math.sqrt(size[i] * size[j])
    }
    for dense in (1, 64, 1000):
        monkeypatch.setattr(similarity, "DENSE", dense)
        got = [p for i, j in similarity._near_rows(at, size, last, marks, np.arange(500), 0.9, 300) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_stored_rows_leave_no_shuffle_files(spark):
    import time

    from litmine.session import cut

    jvm = spark._jvm

    def files():
        found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = files()
    stored = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("id")).count())
    tries = 50
    while files() - before and tries:
        time.sleep(0.2)
        tries -= 1
    assert not files() - before and stored.count() == 7


def test_a_set_that_is_there_twice_keeps_its_pairs(spark):
    words = [f"w{i:02d}" for i in range(40)]
    rows = [(1, words), (1, words), (2, words[1:]), (3, words[:20])]
    got = similarity.similar_sets(spark.createDataFrame(rows, "rep long, items array<string>"))
    assert [(r["a"], r["b"], r["common"]) for r in got.collect()] == [(1, 2, 39)] * 2  # once per row, as similar_sets_lsh
