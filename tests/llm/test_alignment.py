"""Token alignment against a byte-by-byte version that uses the tokenizers' own encode."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from litmine.llm import alignment, registry
from litmine.llm.common import table

FOLDER = "/root/testdata/sf0.001"
A_PATH, B_PATH = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A, B = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


def plain_groups(text):
    """Groups of ids, or none: every byte place is looked at."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(LETTERS[x] for x in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    ends_a, ends_b, at = {}, {}, 0
    for i, x in zip(a, a_bytes):
        ends_a[at := at + len(x)] = i
    at = 0
    for i, x in zip(b, b_bytes):
        ends_b[at := at + len(x)] = i
    groups, of_a, of_b = [], [], []
    for at in range(1, len(whole) + 1):
        of_a += [ends_a[at]] if at in ends_a else []
        of_b += [ends_b[at]] if at in ends_b else []
        if at in ends_a and at in ends_b:
            groups.append((of_a, of_b))
            of_a, of_b = [], []
    return groups


def plain_rows(rows):
    aligned = [(i, plain_groups(t)) for i, t in rows]
    documents, most = Counter(), defaultdict(int)
    for _, groups in aligned:
        documents.update({(x, y) for a, b in groups for x in a for y in b})
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    for i, groups in aligned:
        counts = [(x, documents[x, y]) for a, b in groups for x in a for y in b]
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(counts),
            sum(n == most[x] for x, n in counts), sum(n for _, n in counts),
            sha256(listed.encode()).hexdigest() if groups else "",
        )


def found_rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [tuple(r) for r in df.select(*names).collect()]


RISING = st.lists(st.integers(1, 4), max_size=60).map(np.cumsum)


@given(RISING, RISING, st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_merge_of_the_whole(a, b, piece):
    a, b = a.astype("int64"), b.astype("int64")
    want = [
        (int((a < e).sum()), int((b < e).sum()), int(e), bool(e in a and e in b)) for e in np.union1d(a, b)
    ]
    got = alignment.overlaps(a, b, piece)
    assert [(int(i), int(j), int(e), bool(c)) for i, j, e, c in zip(*got)] == want


@given(RISING, RISING)
@settings(max_examples=100, deadline=None)
def test_crossings_take_equal_shares(a, b):
    a, b = a.astype("int64"), b.astype("int64")
    merged = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
    diagonals = np.arange(len(merged) + 1)
    assert alignment.crossings(a, b, diagonals).tolist() == [sum(not of_b for _, of_b in merged[:k]) for k in diagonals]


TEXTS = [
    "The tokenizers disagree about unbelievable words, 12345 numbers and   spaces.", None, "", " ", "\n\n  \t x", "one",
    "Ünïcödé – 日本語テキスト 😀👩‍👩‍👧 text  with <|endoftext|> and <s> </s> <unk> <0x41> ▁ marks", "Ünïcödé 日本語 😀 only",
    "a" * 700 + " " + "=" * 300 + "漢" * 90, "nul \0 and \x1c\x1d control \x85 \xa0 　 marks", "it's they'LL we've\r\n'd",
    " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "İstanbul ﬁne ① ½ Å é é",
]


def test_rows_of_every_kind(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2**53 + 1, TEXTS[0]), (None, TEXTS[5]), (0, TEXTS[0]), (5, TEXTS[7])]
    docs = spark.createDataFrame([(*r, "x", [1], "y") for r in rows], "doc_id long, text string, a string, b array<int>, groups string")
    key = lambda r: tuple(map(str, r))
    got = alignment.alignment_scores(docs, A_PATH, B_PATH)
    assert sorted(found_rows(got), key=key) == sorted(plain_rows(rows), key=key)
    few = alignment.alignment_scores(docs, A_PATH, B_PATH, frequent=5)
    assert sorted(found_rows(few), key=key) == sorted(plain_rows(rows), key=key)
    assert alignment.alignment_scores(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_large_groups(monkeypatch, spark):
    monkeypatch.setattr(alignment, "SMALL", 1)
    tools = alignment.tokenizers(A_PATH, B_PATH)
    raw = [None if t is None else t.encode() for t in TEXTS[:9]]
    import pyarrow as pa

    many = alignment.align_portion(tools, pa.array(range(9)), [x or b"" for x in raw], 7)
    monkeypatch.setattr(alignment, "SMALL", 10**6)
    assert many == alignment.align_portion(tools, pa.array(range(9)), [x or b"" for x in raw], 1 << 14)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    got = registry.QUERIES["op13_alignment"](spark, FOLDER)
    assert sorted(found_rows(got)) == sorted(plain_rows(rows))
