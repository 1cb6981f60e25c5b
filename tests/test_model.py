import random

import pytest

from pyspark.sql import functions as F

from litmine.operators import labels, model, numbering


def labelled(spark):
    rows = []
    for i in range(120):
        good = i % 2 == 0
        text = f"the structure XXXX was solved number {i}" if good else f"gene variant XXXX in patients number {i}"
        rows.append((f"{1 + i % 9}AB{i % 10}", "PDB_NONE", 2000, f"P{i}", str(i), 2005, False, text, text.lower(), float(good)))
    columns = "pdb_id string, match_type string, deposition_year int, pmc_id string, pm_id string, publication_year int, primary_citation boolean, sentence string, blinded_sentence string, label double"
    return spark.createDataFrame(rows, columns)


def test_split_does_not_depend_on_partitions(spark):
    rows = labelled(spark)
    a, b = model.split(rows, "pmc_id")
    c, _ = model.split(rows.repartition(5), "pmc_id")
    assert a.count() + b.count() == rows.count() and 0 < b.count() < 50
    assert a.subtract(c).count() == 0 and a.count() == c.count()


def test_fit_predict_save(spark, tmp_path):
    rows = labelled(spark)
    training, test = model.split(rows, "pmc_id")
    fitted = model.fit(training, num_features=1 << 12)
    metrics = {r["part"]: r for r in model.evaluate(fitted, training, test).collect()}
    assert metrics["testing"]["f1"] == 1.0 and metrics["testing"]["roc_probability"] == 1.0
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    chosen = model.predict_mentions(again, rows)
    assert tuple(chosen.columns) == labels.LABEL_COLUMNS
    assert chosen.filter("label = 0.0").count() == 0 and chosen.count() == 60
    assert model.predict_primary(again, rows).count() == 60
    model.write_report(model.evaluate(again, training, test), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_confusion(spark):
    rows = [(1.0, 1.0)] * 6 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)] * 3 + [(0.0, 0.0)] * 5
    got = model.confusion(spark.createDataFrame(rows, "prediction double, label double")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (6, 2, 3, 5)
    assert got["f1"] == pytest.approx(12 / 17) and got["roc"] == pytest.approx((6 / 9 + 5 / 7) / 2)
    empty = model.confusion(spark.createDataFrame([(1.0, 1.0)], "prediction double, label double")).first()
    assert empty["fpr"] is None and empty["sensitivity"] == 1.0


def test_roc_is_that_of_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = [(1.0, 1.0)] * 6 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)] * 3 + [(0.0, 0.0)] * 5
    frame = spark.createDataFrame(rows, "prediction double, label double")
    want = BinaryClassificationEvaluator(rawPredictionCol="prediction").evaluate(frame)
    assert model.confusion(frame).first()["roc"] == pytest.approx(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_area_of_probabilities_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(float(rng.randrange(2)), rng.randrange(9) / 8) for _ in range(300)]
    frame = spark.createDataFrame([*rows, (None, 0.5), (1.0, None)], "label double, score double").repartition(7)
    got = model.area_under_roc(frame).first()
    pairs = [(p > q) + (p == q) / 2 for a, p in rows for b, q in rows if a == 1 and b == 0]
    assert got["area"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12) and got["n"] == 300
    one = model.area_under_roc(frame.filter("label = 1")).first()
    assert one["area"] is None and one["positives"] == one["n"]
    assert tuple(model.area_under_roc(frame.limit(0)).first()) == (0, 0, None)


def test_running_sums(spark):
    frame = spark.range(1000).selectExpr("id * 7 % 1000 as x").repartition(7)
    rows = numbering.running_sums(frame, "x", total=F.col("x"), twice=2 * F.col("x")).collect()
    assert {r["x"]: (r["total"], r["twice"]) for r in rows} == {i: (i * (i + 1) // 2, i * (i + 1)) for i in range(1000)}


def test_checks_of_a_fitted_model(spark):
    rows = [("the structure of XXXX", 1.0), ("gene variant XXXX", 0.0), ("the variant of XXXX", 0.0), ("gene structure", 1.0)] * 5
    rows += [("the structure of XXXX", 0.0), ("gene variant XXXX", 1.0)]
    frame = spark.createDataFrame(rows, "blinded_sentence string, label double").coalesce(1)
    fitted = model.fit(frame, tol=1e-9)
    found = model.optimum_check(fitted, frame, 1e-4).first()
    assert tuple(found) == (22, 11, True, True)
    early = model.fit(frame.withColumn("label", 1 - F.col("label")), tol=1e-9)
    assert not model.optimum_check(early, frame, 1e-4).first()["gradient_small"]
    assert tuple(model.score_check(fitted, frame).first()) == (22, 0, 0)


def test_counted_rows_are_the_labelled_rows(spark):
    """Ids with many entries: the counted form has at most four rows a mention, and the same rows with their numbers."""
    rng = random.Random(3)
    found = [(f"f{i % 40}", f"{1 + i % 3}AB1", f"s {i % 7}", f"b {i % 7}", rng.choice(["PDB_NONE", "PDB_ID"])) for i in range(120)]
    pubs = [(f"P{i}" if i % 9 else None, f"{i}" if i % 5 else None, f"f{i}", rng.choice([None, 1999, 2000, 2005])) for i in range(40)]
    entries = [
        (f"{rng.randrange(1, 3)}AB1", rng.choice([None, "P0", *(f"P{i}" for i in range(6))]), rng.choice([None, *map(str, range(6))]),
         rng.choice([None, 1990, 2000, 2003, 2010]), rng.choice([None, 1, 2])) for _ in range(300)
    ]
    mentions = spark.createDataFrame(found, "file_name string, pdb_id string, sentence string, blinded_sentence string, match_type string")
    pubs = spark.createDataFrame(pubs, "pmc_id string, pm_id string, file_name string, publication_year int")
    entries = spark.createDataFrame(entries, "pdb_id string, pmc_id string, pm_id string, deposition_year int, entry_type int")
    whole = labels.label_mentions(labels.merge_metadata(mentions, pubs, entries))
    keys = ["set_name", *[c for c in labels.LABEL_COLUMNS if c != "deposition_year"]]
    want = {tuple(r[c] for c in keys): r["count"] for r in whole.groupBy(*keys).count().collect()}
    counted = labels.count_labelled(mentions, pubs, entries)
    got = counted.collect()
    assert {tuple(r[c] for c in keys): r["copies"] for r in got} == want and len(got) == len(want) <= 4 * 120
    assert {r["set_name"] for r in got} >= {"positives_i", "positives_ii", "negatives_i", "negatives_ii"} and max(want.values()) > 9
    first = labels.beyond(counted.withColumn("copies", F.col("copies") + 2), counted)
    assert first.count() == len(want) and first.filter("copies <> 2").isEmpty() and labels.beyond(counted, counted).isEmpty()


def test_counted_rows_weigh_as_their_copies(spark):
    rows = [("the structure of XXXX", 1.0, 5), ("gene variant XXXX", 0.0, 3), ("the variant of XXXX", 0.0, 2), ("the structure of XXXX", 0.0, 2), ("gene variant XXXX", 1.0, 1), ("the variant of XXXX", 1.0, 1)]
    counted = spark.createDataFrame(rows, "blinded_sentence string, label double, copies bigint").coalesce(1)
    whole = counted.select("blinded_sentence", "label", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("x")).drop("x")
    fitted, plain = model.fit(counted, tol=1e-9), model.fit(whole, tol=1e-9)
    for m in (fitted, plain):
        p = {r["blinded_sentence"]: r["probability"][1] for r in m.transform(counted).collect()}
        assert [p["the structure of XXXX"], p["gene variant XXXX"], p["the variant of XXXX"]] == pytest.approx([5 / 7, 1 / 4, 1 / 3], abs=1e-3)
    assert tuple(model.optimum_check(fitted, counted, 1e-4).first()) == (14, 7, True, True)
    assert tuple(model.score_check(fitted, counted).first()) == (14, 0, 0)
    got = [model.evaluate(fitted, df, df).filter("part = 'testing'").first() for df in (counted, whole)]
    assert got[0][:5] == got[1][:5] == ("testing", 5, 5, 2, 2) and got[0]["roc_probability"] == pytest.approx(got[1]["roc_probability"])
