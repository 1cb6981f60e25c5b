"""The pipeline against its stages written plainly, and what it promises about columns."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
from litmine.llm import quality_classifier, quality_rules, simhash
from litmine.llm.common import stored, table
from litmine.session import checkpoint_dir

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = quality_classifier.quality_scores(docs, table(spark, FOLDER, "labels")).collect()
    good = {r["doc_id"] for r in scores if r["score"] >= quality_classifier.THRESHOLD}
    first = stored(corpus_pipeline.quality_classifier(spark, docs, FOLDER), "test")
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == docs.columns

    second = stored(corpus_pipeline.quality_rules(spark, first, FOLDER), "test")
    base = {
        i for i in good
        if (m := quality_rules.measures(texts[i]))[0] >= 20 and 100 * m[4] <= 30 * m[0]
    }
    assert {r["doc_id"] for r in second.collect()} <= base and second.columns == docs.columns
    assert len(base) - second.count() <= 3  # hosts of ten documents have no frequent lines

    third = stored(corpus_pipeline.near_duplicates(spark, second, FOLDER), "test")
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(texts[i])) for i in (r["doc_id"] for r in second.collect())}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] > root[j]:
                    root[i], changed = root[j], True
    assert {r["doc_id"] for r in third.collect()} == set(root.values()) and third.columns == docs.columns

    packed = corpus_pipeline.run(spark, FOLDER)
    total = packed.groupBy("doc_id").sum("length").collect()
    assert {(r[0], r[1]) for r in total} == {(i, len(texts[i].encode().split()) + 1) for i in set(root.values())}


def test_null_and_shared_ids_lose_no_text(spark):
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    ids = [None, None, None, 7, 7, 7, 8, 9]
    rows = [(doc_id, text(i), "host") for i, doc_id in enumerate(ids)]
    rows += [(7, "too short", "host"), (7, text(0), "host"), (None, text(6), "host"), (8, text(6), "host")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    second = stored(corpus_pipeline.quality_rules(spark, docs, FOLDER), "test")
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(map(tuple, second.collect()), key=key) == sorted([r for r in rows if r[1] != "too short"], key=key)
    third = corpus_pipeline.near_duplicates(spark, second, FOLDER)
    want = [(7, text(0), "host"), *rows[1:8]]
    assert third.columns == docs.columns and sorted(map(tuple, third.collect()), key=key) == sorted(want, key=key)


def test_pipeline_leaves_nothing_but_its_result(spark):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("litmine-*"))
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    left = [p.name for p in set(folder.glob("litmine-*")) - before]
    assert len(left) == 1 and "best-fit-packing" in left[0]


def test_empty_table_and_odd_column_types(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    odd = docs.selectExpr("*", "timestamp'1600-01-01 00:00:00' as at", "map('a', doc_id) as tags", "if(doc_id % 2 = 0, null, doc_id) as half")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("odd", "none"):
        table(spark, FOLDER, "labels").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    key = lambda frame: sorted(map(tuple, frame.select("doc_id", "piece", "begin", "length").collect()))
    assert key(corpus_pipeline.run(spark, f"{tmp_path}/odd")) == key(corpus_pipeline.run(spark, FOLDER))
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    first = corpus_pipeline.quality_classifier(spark, table(spark, f"{tmp_path}/odd", "documents"), FOLDER)
    assert first.dtypes == odd.dtypes
