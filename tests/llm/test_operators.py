"""The ten operators against plain versions, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from litmine.llm import (
    ftrl,
    license_scan,
    masked_lm,
    packing,
    pieces,
    quality_classifier,
    quality_rules,
    registry,
    simhash,
    token_store,
    topk,
    toxicity,
)

DOCS = "doc_id long, text string, source string, score string, row string, shard string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.\nIt ran on and on for many a day in the sun.",
    "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.\nIt ran on and on for many a day in the sun.",
    None,
    "",
    " \n\t ",
    LONG,
    "one",
    "Ünïcödé – 日本語 text  with  double spaces\n\n and <|endoftext|> marks 😀 it's 'fine'",
    " ".join(["again"] * 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else f"h{i % 2}", "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id here", "h0", "x", "y", "z")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_components(prints: list[int], radius: int = 4) -> dict[int, int]:
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in root}


def plain_fingerprint(text: str) -> int:
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    prints = {(r["doc_id"], r["text"]): plain_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == {(i, p) for (i, _), p in prints.items()}
    roots = plain_components(list(set(prints.values())))
    least = defaultdict(list)
    for (i, _), p in prints.items():
        if i is not None:
            least[roots[p]].append(i)
    for r in got:
        assert r["component_id"] == min(least[roots[int(r["fingerprint"], 16)]], default=None)
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(
        {r["component_id"] for r in got if r["component_id"] is not None}
    )


def test_simhash_links_connect_all_that_are_near(spark):
    draw = random.Random(4)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:  # chains of near fingerprints, and one crowd around a centre
        for _ in range(4):
            for b in draw.sample(range(64), draw.randint(1, 5)):
                p ^= 1 << b
            prints.add(p)
    centre = draw.getrandbits(64)
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = plain_components(list(prints))
    for words_per_task in (4_000_000, 2_000):  # the second splits the crowded keys
        nodes = spark.createDataFrame(signed, "print long")
        edges = simhash.links(nodes, words_per_task, min_key_bits=6)
        root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        groups = defaultdict(set)
        for (p,) in signed:
            groups[root.get(p, p)].add(p % (1 << 64))
        plain = defaultdict(set)
        for p, r in want.items():
            plain[r].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def plain_repeats(words: list[bytes]) -> int:
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    return len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)})


def test_quality_rules_measures(docs, empty):
    draw = random.Random(2)
    for _ in range(300):
        words = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 60))]
        assert quality_rules.repeated_words(words) == plain_repeats(words)
    assert quality_rules.measures("a#b\n\na#b\n \na#b\tc |") == (5, 11, 4, 1, 0)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[2]["n_words"] == got[3]["n_words"] == got[4]["n_words"] == 0 and got[2]["base_failed"]
    assert got[0]["kept"] and got[5]["kept"] and got[8]["base_failed"] and not got[8]["kept"]
    assert quality_rules.quality_rules(docs).count() == docs.count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_lines_across_documents(spark):
    menu = "Home  Products ABOUT us contact " + " ".join(f"Section{k}" for k in range(18))
    own = lambda i: " ".join(f"{w}{i}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    rows = [(i, f"{menu.lower() if i % 2 else menu}\n{own(i)} {own(i + 1000)}", "shop") for i in range(40)]
    rows += [(100 + i, f"{menu} \n{own(i)[:12]}", "shop") for i in range(3)]
    rows += [(200 + i, f"{menu}\n{own(i)}", "other") for i in range(3)]
    rows += [(300 + i, own(7) + " " + own(8) + "\n" + own(9), "copies") for i in range(60)]
    limits = quality_rules.Limits(documents=20, share=0.1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame, limits=limits).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 23 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(3)) and not got[100]["base_failed"]
    assert all(got[200 + i]["removed_words"] == 0 and got[200 + i]["kept"] for i in range(3))
    assert all(got[300 + i]["kept"] for i in range(60))  # copies of one text are one document to the count
    assert quality_rules.kept_documents(frame, limits=limits).columns == frame.columns


def test_quality_rules_remove_lines(spark):
    menu = "Home products about us contact"
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(25))
    rows = [(i, f"{menu.upper()}\n\n{own(i)}\n  {menu}", "shop", i) for i in range(40)]
    rows += [(100, f"{menu}\n{own(100)}", "other", 7), (101, None, "shop", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    limits = quality_rules.Limits(documents=20)
    want = {i: f"\n{own(i)}" for i in range(40)} | {100: rows[40][1]}
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame, limits=limits).collect()}
    assert {i: r["text"] for i, r in got.items()} == want | {101: None}
    kept = quality_rules.kept_documents(frame, limits=limits)
    assert kept.schema == frame.schema and {r["doc_id"]: r["text"] for r in kept.collect()} == want
    assert {r["doc_id"]: r["row"] for r in kept.collect()} == {r[0]: r[3] for r in rows[:41]}


def test_quality_rules_limit_does_not_grow_with_the_host(spark):
    note = "Sign up for our letter today"
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(25))
    rows = [(i, own(i) + ("\n" + note if i < 25 else ""), "hot") for i in range(3_000)]
    rows += [(5_000 + i, own(i) + ("\n" + note if i < 20 else ""), "few") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["removed_words"] for r in quality_rules.quality_rules(frame).collect()}
    assert all(got[i] == (6 if i < 25 else 0) for i in range(3_000))
    assert all(got[5_000 + i] == 0 for i in range(30))  # 20 documents are not over the limit


def test_packing(spark, docs, empty):
    draw = np.random.default_rng(1)
    sizes = np.concatenate([draw.integers(0, 300, 500), [256, 256, 0, 255, 1]])
    bins, places, lengths = packing.best_fit(sizes, (64, 128, 256, 512))
    spans = defaultdict(list)
    for s, b, p in zip(sizes, bins, places):
        spans[b].append((p, p + s))
    for b, inside in spans.items():
        inside.sort()
        assert all(x[1] <= y[0] for x, y in zip(inside, inside[1:]))
        assert inside[-1][1] <= lengths[b] and (lengths[b] == 64 or inside[-1][1] > lengths[b] // 2)
    assert sizes.sum() / lengths.sum() > 0.95
    got = packing.packed_documents(docs).collect()
    whole = Counter()
    for r in got:
        whole[r["doc_id"]] += r["length"]
        assert r["begin"] == r["piece"] * 2048 and r["place"] + r["length"] <= r["bin_length"]
    assert whole[5] == 30_001 and whole[2] == whole[3] == whole[4] == 1 and whole[0] == 2 * whole[1]
    assert packing.packed_documents(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, -5), (3, 0)], "doc_id long, length long")
    assert sorted(r["length"] for r in packing.pack(odd).collect()) == [0, 0, 0]


def plain_best_fit(sizes: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Best fit by looking at every open bin: bin of each size, and room that was opened for each bin."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [sizes[i] for i in order]
    room, opened, used, bins = [], [], [], [0] * len(sizes)
    for n, i in enumerate(order):
        fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
        if not fits:
            length = packing.cheapest(n, falling, [-x for x in falling], lengths, packing.OVERHEAD)
            room.append(length)
            opened.append(length)
            used.append(0)
            fits = [len(room) - 1]
        tight = min(room[b] for b in fits)
        chosen = max((b for b in fits if room[b] == tight), key=lambda b: used[b])  # the one that got its room last
        room[chosen] -= sizes[i]
        used[chosen] = n + 1
        bins[i] = chosen
    return bins, [min(x for x in lengths if x >= o - r) for o, r in zip(opened, room)]


def test_packing_is_best_fit():
    draw = random.Random(5)
    for _ in range(20):
        sizes = [draw.randint(1, 60) for _ in range(draw.randint(1, 80))]
        bins, _, lengths = packing.best_fit(np.array(sizes), (16, 32, 64))
        assert (bins.tolist(), lengths.tolist()) == plain_best_fit(sizes, [16, 32, 64])


def test_packed_sequences_hold_every_token_once(spark, docs):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = [(i, r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for i, r in enumerate(docs.collect())]
    tokens = spark.createDataFrame(ids, "row long, doc_id long, ids array<int>")
    placed = packing.pack(tokens.withColumn("length", F.size("ids")), key="row").collect()
    frame = spark.createDataFrame(placed)
    made = {r["bin_id"]: r for r in packing.sequences(tokens, frame).collect()}
    assert sum(len(r["ids"]) for r in made.values()) == sum(len(x[2]) for x in ids)
    for r in placed:
        piece = ids[r["row"]][2][r["begin"] : r["begin"] + r["length"]]
        found = made[r["bin_id"]]
        assert found["ids"][r["place"] : r["place"] + r["length"]] == piece and len(found["ids"]) <= found["bin_length"]
        assert r["doc_id"] == ids[r["row"]][1]


BIG = 9_007_199_254_740_993  # not a float64


def test_ids_and_other_columns_stay_what_they_are(spark):
    """Long ids beside null ids, and columns of types that pandas changes or refuses."""
    labelled_docs, labels = labelled(spark, "buy now buy now", "quality")
    odd = spark.sql(f"""
        select * from values
          ({BIG}L, 'some text of a few words', timestamp'1600-01-01 00:00:00', map('a', null), {BIG}L, date'0001-01-01'),
          (null, null, null, null, null, null),
          ({BIG}L, 'some text of a few words', null, map('b', 1), null, null)
        as t(doc_id, text, at, tags, extra, day)""")
    docs = labelled_docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True)
    want = Counter(r["doc_id"] for r in docs.collect())
    held_out = crc32(str(BIG).encode()) % 4 == 2
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == want
    assert {r["held_out"] for r in got if r["doc_id"] == BIG} == {held_out}
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    toxic = toxicity.toxicity_scores(docs, labels.withColumnRenamed("quality", "toxic")).collect()
    assert Counter(r["doc_id"] for r in toxic) == want
    assert {r["held_out"] for r in toxic if r["doc_id"] == BIG} == {crc32(str(BIG).encode()) % 3 == 1}
    near = simhash.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in near) == {BIG: 2, None: 1}
    assert {r["component_id"] for r in near if r["doc_id"]} == {BIG}
    assert Counter(r["doc_id"] for r in packing.packed_documents(odd).collect()) == {BIG: 2, None: 1}
    kept = quality_classifier.good_documents(docs, labels)
    assert kept.schema == docs.schema
    scores = {(r["doc_id"], r["score"]) for r in got}
    good = {i for i, x in scores if x >= quality_classifier.THRESHOLD}
    whole = lambda frame: sorted(
        frame.select("doc_id", "text", F.col("at").cast("string"), "extra", F.col("day").cast("string"), F.size("tags")).collect(), key=str
    )
    assert whole(kept) == [r for r in whole(docs) if r["doc_id"] in good]
    plan = quality_classifier.quality_scores(labelled_docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInPandas" not in plan


def test_long_text_and_clashing_columns(spark, empty):
    docs, labels = labelled(spark, "buy now buy now", "quality")
    more = docs.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("score", "row", "label", "shard", "predicted", "held_out"))])
    long = spark.createDataFrame([(10_000, " ".join(["buy now"] * 200_000))], "doc_id long, text string")
    more = more.unionByName(long, allowMissingColumns=True)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(more, labels).collect()}
    plain = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(docs.select("doc_id", "text"), labels).collect()}
    assert all(abs(got[i] - plain[i]) < 1e-6 for i in plain) and 0.0 <= got[10_000] <= 1.0
    assert quality_classifier.good_documents(more, labels).columns == more.columns


def test_license_scan_rows_that_share_an_id(spark):
    """A part of a notice in other texts of the same id does not hide the whole of it."""
    header = dict(license_scan.NOTICES)["GPL-3.0 header"].split()
    part = header[: int(len(header) * 0.78)]
    rows = [(7, " ".join([*part, f"other{i}", "words"])) for i in range(40)] + [(7, " ".join(header))]
    rows += [(None, " ".join(header)), (None, " ".join(part)), (None, " ".join(header))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.notices(spark)).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got if r["containment"] == 1.0) == {
        (7, "GPL-3.0 header"): 1, (None, "GPL-3.0 header"): 1
    }
    assert all(r["license"] == "GPL-3.0 header" for r in got)


def test_license_scan_short_templates_and_two_of_a_name(spark):
    templates = [("short", "All rights reserved."), ("one", "copyleft"), ("two", "see the file COPYING of this tree"),
                 ("two", "the terms are those of the file LICENSE"), ("none", " .. "), ("void", None)]
    docs = [(1, "(c) 2001 somebody, all Rights reserved, and so on"), (2, "all rights reserved"), (3, "all rights are reserved"),
            (4, "this is copyleft"), (5, "here the terms are those of the file LICENSE only"), (6, "rights reserved"), (7, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(templates, "license string, text string")
    got = {(r["doc_id"], r["license"]): r["begin"] for r in license_scan.scan(frame, known).collect()}
    assert set(got) == {(1, "short"), (2, "short"), (4, "one"), (5, "two")}
    assert got[1, "short"] == 3 and got[4, "one"] == 2


def test_texts_are_cut_as_by_the_pattern(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t\r\xa0\x85 \0aé1.,'s\x1c漢") for _ in range(rng.randrange(7))) for _ in range(20_000)]
    assert [token_store.unsafe(x) for x in texts] == [token_store._UNSAFE.search(x) is not None for x in texts]
    monkeypatch.setattr(token_store, "_UNSAFE", None)  # plain texts do not need the pattern
    assert not token_store.unsafe("Un café, 1 + 1.\nIt's fine.") and token_store.unsafe("a  b") and token_store.unsafe("a\n b")


def test_token_store(spark, docs, empty, tmp_path):
    path, file = str(tmp_path / "store"), str(public_tokenizers.path("byte_bpe_50k.json"))
    token_store.write_tokens(docs, path, file)
    library, start, want = Tokenizer.from_file(file), 0, []
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    order = lambda r: (r[1], r[2])
    assert sorted(map(tuple, token_store.digests(spark, path).collect()), key=order) == want
    some = token_store.read_tokens(spark, path, [1, 5])
    assert sorted(r["doc_id"] for r in some.collect()) == [1, 5]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    token_store.write_tokens(empty, str(tmp_path / "none"), file)
    assert token_store.digests(spark, str(tmp_path / "none")).count() == 0


def test_topk(spark):
    draw = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in draw.normal(0, 0.3, (300, 9))]
    vectors += [vectors[0]] * 30 + [None, [float("nan")] * 9, [None] * 9, [float("inf")] + [0.0] * 8, [], [0.5] * 4]
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank int")
    rows = topk.whole_vectors(frame)
    whole = {}
    for i, v in enumerate(vectors):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = np.zeros(9, dtype="int64")
            whole[i][: len(v)] = [int(np.floor(64 * float(np.float32(x)))) for x in v]
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        found = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    for shard_rows in (16_384, 50):
        got = topk.search(rows, rows.filter("vec_id % 20 = 0"), shard_rows=shard_rows, block_queries=7)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.search(rows.limit(0), rows.limit(0)).count() == 0


def test_topk_batches_are_exact():
    """Every type of number in use, and queries together against one by one: the sums are exact and ties go by id."""
    draw = np.random.default_rng(4)
    kinds = set()
    for scale in (8, 3_000, 40_000_000):
        vectors = np.round(draw.normal(0, scale, (400, 7))).astype("int64")
        vectors[50:80] = vectors[0]
        ids = draw.permutation(400)
        shard = topk.Shard(ids, vectors, 5)
        kinds.add(topk._exact_kind(vectors[:150], vectors))
        for query_id, query, (found, scores) in zip(ids, vectors[:150], shard.search(ids[:150], vectors[:150], 5)):
            whole = vectors.astype(object) @ query.astype(object)
            want = sorted((-int(s), int(i)) for s, i in zip(whole, ids) if i != query_id)[:5]
            assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == want
    assert kinds == {"float32", "float64", "int64"}
    empty = topk.Shard(np.arange(3), np.zeros((3, 1), dtype="int64"), 2)
    assert [x[0].tolist() for x in empty.search(np.array([1]), np.zeros((1, 1), dtype="int64"), 2)] == [[0, 2]]


def test_pieces(spark, docs, empty):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = SentencePieceProcessor(model_file=path)
    encoded = pieces.encode(docs, path)
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str)
    want = sorted(((r["doc_id"], library.encode(r["text"] or "")) for r in docs.collect()), key=str)
    assert got == want
    back = sorted(((r["doc_id"], r["text"]) for r in pieces.decode(encoded, path).collect()), key=str)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    assert pieces.encode(empty, path).count() == 0


def test_pieces_query_decodes_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = registry.op5_pieces(spark, folder).select("doc_id", "decoded_md5").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], md5((r["text"] or "").encode()).hexdigest()) for r in docs)


def test_pieces_of_runs_and_rare_words(spark):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = SentencePieceProcessor(model_file=path)
    draw = random.Random(5)
    found = ["a" + " " * n + "b" for n in range(41)] + [" " * n for n in (1, 15, 16, 17, 33)] + ["\n\n \n", "aaaa aaaaa", "ÿ\U0001f600 x"]
    found += [" ".join("".join(draw.choice("aetnos") for _ in range(draw.randint(1, 14))) for _ in range(30)) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for frequent in (3, 10_000):
        got = {r["doc_id"]: r["ids"] for r in pieces.encode(rows, path, frequent).collect()}
        assert got == {i: library.encode(text) for i, text in enumerate(found)}


def test_pieces_lattice_has_as_many_parts_as_its_words_need(spark, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_PER_TASK", 10)
    table = spark.createDataFrame([("a", 0, -1.0), ("ab", 1, -2.0)], "piece string, id int, score double")
    words = spark.createDataFrame([("ab" * i,) for i in range(1, 401)], "word string")
    assert pieces.lattice(words, table, 2, 1000).rdd.getNumPartitions() >= 40


def test_pieces_moves_rare_words_to_their_rows_without_text(spark):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    rows = spark.createDataFrame([(1, "one two three two")], "doc_id long, text string")
    plan = pieces.encode(rows, path, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(at#" in plan and "collect_list(word#" not in plan


def test_viterbi_fold(spark):
    scores = {"▁": -2.0, "a": -3.0, "b": -3.1, "ab": -3.5, "ba": -3.4, "aba": -6.0, "▁a": -2.5, "abab": -6.7}
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(scores.items())], "piece string, id int, score double")
    draw = random.Random(1)
    words = {"▁" + "".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(60)}
    edges = pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), table, 4, 1000)
    ids = list(scores)
    for r in edges.select("word", pieces.viterbi("edges", 20.0).alias("ids")).collect():
        best = [0.0] + [1e18] * len(r["word"])
        for end in range(1, len(r["word"]) + 1):
            for begin in range(max(0, end - 4), end):
                part = r["word"][begin:end]
                cost = -scores[part] if part in scores else 20.0 if end - begin == 1 else 1e18
                best[end] = min(best[end], best[begin] + cost)
        total = sum(-scores[ids[i]] if i < 1000 else 20.0 for i in r["ids"])
        assert abs(total - best[-1]) < 1e-9


def test_license_scan(spark, docs, empty):
    header = dict(license_scan.NOTICES)["Apache-2.0 header"].split()
    edited = [w for i, w in enumerate(header) if i not in (20, 21)]
    more = [
        (50, " ".join(["filler"] * 37 + header + ["tail"] * 9), 3),
        (51, " ".join(f"f{i}" for i in range(101)) + " " + " ".join(edited).upper(), 3),
        (52, "licensed under terms of the version of a license that is not known 2.0", 3),
    ]
    frame = docs.select("doc_id", "text", F.lit(3).alias("begin")).union(spark.createDataFrame(more, "doc_id long, text string, begin int"))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.scan(frame, license_scan.notices(spark)).collect()}
    want = {(0, "MIT"): 1.0, (1, "MIT"): 1.0, (50, "Apache-2.0 header"): 1.0}
    assert {k: v for k, v in got.items() if k[1] != "Apache-2.0" and k[0] != 51} == want
    assert (50, "Apache-2.0") in got and 0.8 <= got[51, "Apache-2.0 header"] < 1
    assert not any(k[0] == 52 for k in got)
    assert license_scan.scan(empty, license_scan.notices(spark)).count() == 0
    assert license_scan.scan(docs, license_scan.notices(spark).limit(0)).count() == 0


def test_masked_lm(spark, empty):
    draw = random.Random(5)
    rows = [(i, " ".join("abcdefgh"[(i + k) % 8] * 3 for k in range(80))) for i in range(60)]
    rows += [(100, " ".join(draw.choice("abcdefgh") * 3 for _ in range(80))), (101, None), (102, "aaa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    training = masked_lm.Training(rounds=4, stride=2, batch=64)
    got = {r["doc_id"]: r for r in masked_lm.pseudo_likelihood(frame, training).collect()}
    assert got[101]["n_words"] == 0 and got[101]["mean_log_likelihood"] is None and got[102]["n_words"] == 1
    assert np.mean([got[i]["mean_log_likelihood"] for i in range(60)]) > got[100]["mean_log_likelihood"] + 1
    assert masked_lm.pseudo_likelihood(empty).count() == 0


def test_masked_lm_takes_every_word_once(spark):
    t = masked_lm.Training()
    offsets = np.array([0, 0, 1, 3, 18, 50, 51])
    taken = np.concatenate([masked_lm.targets_of(offsets, t, turn) for turn in range(t.rounds)])
    assert sorted(taken) == list(range(51))
    draw = random.Random(5)
    rows = [(i, " ".join("abcdefgh"[(i + k) % 8] * 3 for k in range(80))) for i in range(3_000)]
    rows += [(10_000, " ".join(draw.choice("abcdefgh") * 3 for _ in range(80)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.pseudo_likelihood(frame).collect()}
    assert np.mean([got[i] for i in range(3_000)]) > got[10_000] + 1


def test_masked_lm_neighbours():
    """Neighbours at the ends of documents, empty ones among them, are borders; one class of a row alone has the same value."""
    offsets = np.array([0, 0, 3, 3, 4, 9])
    classes = np.arange(9, dtype="int16")
    line, at = masked_lm.bordered(classes, offsets)
    border, doc = masked_lm.BORDER, np.repeat(np.arange(5), np.diff(offsets))
    want = [[w + s if 0 <= w + s < 9 and doc[w + s] == doc[w] else border for s in (-2, -1, 1, 2)] for w in range(9)]
    context = masked_lm.contexts(line, at)
    assert context.tolist() == want
    p = masked_lm.begin(2)
    whole = masked_lm.log_probabilities(p, context)[1][np.arange(9), classes]
    assert np.allclose(masked_lm.target_log_probability(p, context, classes), whole, atol=1e-5)


def test_masked_lm_gradient():
    draw = np.random.default_rng(0)
    p = masked_lm.begin(1).astype("float64")
    context = draw.integers(0, masked_lm.CLASSES, (5, 4))
    target = draw.integers(0, masked_lm.CLASSES, 5)
    loss = lambda q: -masked_lm.log_probabilities(q, context)[1][np.arange(5), target].mean()
    moved, squares = p.copy(), np.zeros_like(p)
    masked_lm.learn(moved, squares, context, target, 1e-3)
    at = np.argsort(-squares)[:40]
    for i in at:
        up, down = p.copy(), p.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5) == pytest.approx(np.sqrt(squares[i]), rel=1e-3)
    assert loss(moved) < loss(p)


def labelled(spark, bad: str, label: str, n: int = 400):
    draw = random.Random(8)
    words = ["".join(draw.choice("aeioubcdfglmnprst") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(60)]
        wrong = i % 3 == 0
        for _ in range(8 if wrong else 0):
            text.insert(draw.randrange(60), bad)
        rows.append((i, " ".join(text)))
        marks.append((i, int(wrong) if label == "toxic" else int(not wrong)))
    rows += [(1_000, None), (1_001, ""), (None, "no id")]
    marks += [(1_000, None), (None, 1), (3, marks[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, f"doc_id long, {label} int")


def test_quality_classifier(spark, empty):
    docs, labels = labelled(spark, "$$$ ###", "quality")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert {r["score"] for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    assert quality_classifier.good_documents(docs, labels).columns == docs.columns


def test_toxicity(spark, empty):
    docs, labels = labelled(spark, "moron", "toxic")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean = next(r["text"] for r in docs.collect() if truth.get(r["doc_id"]) == 0)
    hidden = ["m0r0n", "m o r o n", "m.o.r.o.n", "mooorrron", "MORON", "m-o-r-o-n"]
    rows = [(2_000 + i, f"{clean} {h} {h} {h}") for i, h in enumerate(hidden)] + [(3_000, clean)]
    frame = docs.union(spark.createDataFrame(rows, docs.schema))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(frame, labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and truth.get(i) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(got[2_000 + i]["predicted"] == 1 for i in range(len(hidden))) and got[3_000]["predicted"] == 0
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_toxicity_decodes_any_length():
    c = np.concatenate([np.zeros(3, "uint8"), toxicity._codes("you are stupid lass hello ass " * 300)]).astype("int64")
    windows = ((c[:-3] * 28 + c[1:-2]) * 28 + c[2:-1]) * 28 + c[3:]
    model = toxicity.character_model(np.bincount(windows, minlength=28**4))
    assert toxicity.restore(".-.".join(".".join(w) for w in ["you", "are", "stupid"] * 300), model) == ["you", "are", "stupid"] * 300
    row = " ".join(" ".join("stupid") for _ in range(400))
    assert toxicity.decode(toxicity.lattice(row), model).split() == ["stupid"] * 400
    words = toxicity.Words(model, 1 << 16)
    want = set(np.frombuffer(words.ids(["stupid", *"stupid"]), dtype="uint32").tolist())
    assert set(words(row)[0].tolist()) == want
    assert toxicity.restore("a$$", model) == ["ass"]
    assert toxicity.restore("stupid!!", model) == ["stupid"] and toxicity.restore("he!!o", model) == ["hello"]


def test_toxicity_decodes_tokens_without_letters(spark):
    words = ["the sash was a class act", "an ass and a mass of grass", "some pass the lass as assets"] * 30
    model = toxicity.count_model(spark.createDataFrame([(w,) for w in words], "text string"))
    assert toxicity.restore("@$$", model) == ["ass"]
    assert toxicity.restore("@$$,", model) == ["ass"]
    for plain, want in (("100", ["100"]), ("$100", ["100"]), ("****", []), ("2001", ["2001"]), ("!!", [])):
        assert toxicity.restore(plain, model) == want


def test_ftrl_starts_where_it_is_told():
    s = ftrl.Settings(buckets=8)
    start = np.array([0.5, -0.25, 0, 0, 0, 0, 0, 0, 1.0])
    assert np.allclose(ftrl.ftrl([], start, s), start)
