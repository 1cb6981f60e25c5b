import datetime as dt

from pyspark.sql import functions as F

from litmine.operators import analysis, labels

COLUMNS = "pdb_id string, file_name string, sentence string, blinded_sentence string, match_type string, match boolean"


def build(spark):
    found = spark.createDataFrame(
        [
            ("1AAA", "f1", "s", "b", "PDB_NONE", False),  # primary by PMC id
            ("2BBB", "f1", "s", "b", "PDB_ID", True),  # known, structured, not primary
            ("3CCC", "f1", "s", "b", "PDB_NONE", False),  # deposited later
            ("4DDD", "f1", "s", "b", "PDB_ID", True),  # unknown id
            ("5EEE", "f1", "s", "b", "PDB_NONE", False),  # unassigned
            ("6FFF", "f1", "s", "b", "PDB_ID", True),  # no year: in no set
            ("7GGG", "f1", "s", "b", "PDB_ID", True),  # equal PubMed id but no PMC id: not primary
            ("1AAA", "f9", "s", "b", "PDB_NONE", False),  # unknown file: gone
        ],
        COLUMNS,
    )
    files = spark.createDataFrame([("P1", "11", "f1", dt.date(2015, 1, 1))], "pmc_id string, pm_id string, file_name string, update_date date")
    articles = spark.createDataFrame([("J", 2010, "P1")], "journal string, publication_year int, pmc_id string")
    entries = spark.createDataFrame(
        [("1AAA", "P1", "99", 2009, 1), ("2BBB", "P7", "98", 2009, 1), ("3CCC", "P1", "97", 2012, 1),
         ("5EEE", None, "96", 2010, 2), ("6FFF", "P3", "95", None, 3), ("7GGG", None, "11", 2000, 1)],
        "pdb_id string, pmc_id string, pm_id string, deposition_year int, entry_type int",
    )
    merged = labels.merge_metadata(found, labels.publications(files, articles), entries.limit(3), entries.subtract(entries.limit(3)))
    return merged, articles


def test_sets(spark):
    merged, _ = build(spark)
    got = {r["pdb_id"]: (r["set_name"], r["label"]) for r in labels.label_mentions(merged).collect()}
    assert got == {
        "1AAA": ("positives_i", 1.0),
        "2BBB": ("positives_ii", 1.0),
        "3CCC": ("negatives_i", 0.0),
        "4DDD": ("negatives_ii", 0.0),
        "5EEE": ("unassigned", 0.0),
        "7GGG": ("positives_ii", 1.0),
    }


def test_duplicate_entries_fan_out(spark):
    merged, _ = build(spark)
    assert merged.count() == 7


def test_stored_sets(spark, tmp_path):
    merged, _ = build(spark)
    labels.write_label_sets(labels.label_mentions(merged), str(tmp_path / "sets"))
    back = spark.read.parquet(str(tmp_path / "sets"))
    assert labels.label_set(back, labels.POSITIVES_II).count() == 2


def test_exclusions(spark):
    frame = spark.createDataFrame([("3DNA",), ("1AND",), ("2H2O",), ("1ABC",)], "pdb_id string")
    assert [r[0] for r in labels.drop_excluded(frame).collect()] == ["1ABC"]


def test_training_set_of_primaries(spark):
    merged, _ = build(spark)
    sets = labels.label_mentions(merged)
    extra = sets.filter("pdb_id = '2BBB'").selectExpr("*").replace({"s": "was deposited by"}, subset=["sentence"])
    rows = labels.primary_training_set(sets.filter("pdb_id <> '2BBB'").unionByName(extra)).collect()
    assert sorted((r["pdb_id"], r["label"]) for r in rows) == [("1AAA", 1.0), ("7GGG", 0.0)]


def test_rollup_identity(spark):
    rows = [(2000, "P1"), (2000, "P1"), (2000, "P2"), (2001, "P3")]
    frame = spark.createDataFrame(rows, "publication_year int, pmc_id string")
    got = {r["publication_year"]: r for r in analysis.mean_mentions(frame).collect()}
    # with subtotals: 2 * total / (articles + 1)
    assert got[2000]["mean_rollup"] == 2 * 3 / (2 + 1) and got[2000]["mean_per_article"] == 1.5
    assert got[2001]["mean_rollup"] == 1.0
    assert got[None]["mean_rollup"] == 4.0 and got[None]["mean_per_article"] is None


def test_compare_and_ratio(spark):
    mentions = spark.createDataFrame([("A", "P1", 2000), ("A", "P2", 2000), ("B", "P2", 2000)],
                                     "pdb_id string, pmc_id string, publication_year int")
    articles = spark.createDataFrame([("j", 2000, p) for p in ("P1", "P2", "P3", "P4")],
                                     "journal string, publication_year int, pmc_id string")
    external = spark.createDataFrame([("P2",), ("P3",), ("P3",), ("X",)], "pmc_id string")
    assert [r[0] for r in analysis.only_ours(mentions, external, articles).collect()] == ["P1"]
    assert [r[0] for r in analysis.only_theirs(mentions, external, articles).collect()] == ["P3"]
    row = analysis.mention_ratio(mentions, articles).first()
    assert (row["publications"], row["mentions"], row["ratio"]) == (4, 2, 0.5)


def test_ids_with_many_entries_keep_their_parts_and_sets(spark, tmp_path):
    """Parts are not merged by the size of what they read, as the join makes many rows of few; sets are written without a sort."""
    ids = spark.range(400).select(F.concat(F.lit("1AB"), F.col("id") % 4).alias("pdb_id"), F.col("id").cast("string").alias("nr"))
    mentions = ids.select("pdb_id", F.col("nr").alias("file_name"), *[F.lit("x").alias(c) for c in ("sentence", "blinded_sentence", "match_type")])
    pubs = ids.select(F.col("nr").alias("file_name"), F.col("nr").alias("pmc_id"), F.col("nr").alias("pm_id"), F.lit(2005).alias("publication_year"))
    entries = ids.select("pdb_id", F.lit("P").alias("pmc_id"), F.lit("p").alias("pm_id"), (F.col("nr").cast("int") + 1800).alias("deposition_year"), F.lit(1).alias("entry_type"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = labels.merge_metadata(mentions, pubs, entries)
        assert merged.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
        assert merged.count() == 400 * 100
        before = spark.conf.get(labels.WRITERS)
        labels.write_label_sets(labels.label_mentions(merged), str(tmp_path / "sets"))
        assert spark.conf.get(labels.WRITERS) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    read = spark.read.parquet(str(tmp_path / "sets"))
    assert {r["set_name"]: r["count"] for r in read.groupBy("set_name").count().collect()} == {"negatives_i": 400 * 194 // 4, "positives_ii": 400 * 206 // 4}
