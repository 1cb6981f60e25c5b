import re

import pytest
from pyspark.sql import functions as F

from litmine.operators import mentions
from litmine.operators.rules import CONTACT, PDB


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)], "file_name string, text string")


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


CLASSES = {
    "See 10.2210/pdb4cf7/pdb for it": "PDB_DOI",
    "PDB ID: 1STP": "PDB_ID",
    "PDBID 1STP": "PDB_ID",
    "the 1ABCentry of 1ABC": "PDB_ENTRY",
    "load 1ABC.pdb": "PDB_FILE",
    "explore.do?structureId=2wuy": "RCSB_PDB_URL1",
    "explore.cgi?pdbId=1DLH": "RCSB_PDB_URL2",
    "structidSearch.do?structureId=3SDM": "RCSB_PDB_URL3",
    '<ext-link ext-link-type="pdb" xlink:href="1STP">x': "PDB_EXT_LINK",
    "in PDB (1ABC)": "PDB_SKIP_0",
    "PDB code 1ABC": "PDB_SKIP_1",
    "pdb entry number 1abc": "PDB_SKIP_2",
    "accession 1ABC": "ACCESSION_SKIP_0",
    "Accession code 1ABC": "ACCESSION_SKIP_1",
    "accession number of 1ABC": "ACCESSION_SKIP_2",
    "the K165C enzyme (4AHQ) binds": "PDB_NONE",
    "cytochrome P450 2C19 gene": "PDB_NONE",
    # The only hit of the first rule holds four digits, so the rule is skipped, and so are those that start there.
    "PDB ID: 1999 with a long way to 1ABC": "PDB_NONE",
    "PDB ID: 1999 accession 1ABC": "ACCESSION_SKIP_0",
    "nothing at all": "PDB_NONE",
}


@pytest.mark.parametrize("sentence,expected", CLASSES.items())
def test_classes(spark, sentence, expected):
    assert one(spark, sentence, mentions.classify) == expected


def test_class_with_line_end_in_hit(spark):
    assert one(spark, "PDB code\nnumber\n1ABC", mentions.classify) == "PDB_SKIP_2"


IDS = {
    "1ABC 1abc 2XYZ 1ABC": ["1ABC", "2XYZ"],
    "mixed 1aBC and short 1AB and long 1ABCD": [],
    "numbers 1999 2015": [],
    "0.1ABC and ·2H2O but 3H2O": ["3H2O"],
    "zero 0ABC": [],
    "doi 10.2210/pdb4cf7/pdb": ["4CF7"],
    "doi 10.2210/pdb1999/pdb": ["1999"],
    "1ABC.": ["1ABC"],
    "(9zzz)": ["9ZZZ"],
}


@pytest.mark.parametrize("sentence,expected", IDS.items())
def test_ids(spark, sentence, expected):
    assert one(spark, sentence, mentions.find_ids) == expected


def plain_ids(text):
    found = set()
    for hit in re.finditer(r"\b[1-9](?:[A-Z0-9]{3}|[a-z0-9]{3})\b", text, re.ASCII):
        if not hit.group().isdigit() and not (hit.start() and text[hit.start() - 1] in ".·"):
            found.add(hit.group().upper())
    return sorted(found)


def test_ids_against_plain_scan(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("12AbBc0 .·-x9_") for _ in range(60)) for _ in range(400)]
    got = docs(spark, *texts).select("text", mentions.find_ids(F.col("text")).alias("ids")).collect()
    assert [r["ids"] for r in got] == [plain_ids(r["text"]) for r in got]


def test_prefilter_ignores_prefix_rule(spark):
    text = "A dose of 0.1ABC."
    assert one(spark, text, mentions.may_hold_id) is True
    assert mentions.mine_mentions(docs(spark, text)).count() == 0


def test_rows(spark):
    text = "First one. We solved <b>1ABC</b>\tand\n\n 2XYZ (1abcd). PDB code 3DEF was used! None here"
    rows = {r["pdb_id"]: r for r in mentions.mine_mentions(docs(spark, text, "no id here")).collect()}
    assert set(rows) == {"1ABC", "2XYZ", "3DEF"}
    assert rows["1ABC"]["sentence"] == "We solved 1ABC and 2XYZ (1abcd)."
    assert rows["1ABC"]["blinded_sentence"] == "we solved XXXX and XXXX (XXXXd)."
    assert rows["1ABC"]["sentence_no"] == 1
    assert (rows["1ABC"]["match_type"], rows["1ABC"]["match"]) == ("PDB_NONE", False)
    assert (rows["3DEF"]["match_type"], rows["3DEF"]["match"]) == ("PDB_SKIP_1", True)


def test_id_search_runs_once(spark):
    plan = mentions.mine_mentions(docs(spark, "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_contact_pack(spark):
    text = "Mail to ann.b+c@site.org now. Host 10.0.0.255 is up. Call +1 (555) 123-4567. Some Licence text."
    rows = {r["found"]: r["match_type"] for r in mentions.mine_mentions(docs(spark, text), CONTACT, "found").collect()}
    assert rows == {
        "ann.b+c@site.org": "EMAIL", "10.0.0.255": "IPV4", "+1 (555) 123-4567": "PHONE", "Licence": "LICENCE",
    }


@pytest.mark.parametrize("pack", [CONTACT, PDB], ids=lambda p: p.name)
def test_prefilter_keeps_every_hit(spark, pack):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("12aB.@ -()+liceNs5é") for _ in range(25)) + rng.choice(["", "license", "1.2.3.4", "a@b.c"])
             for _ in range(600)]
    rows = docs(spark, *texts).select(
        mentions.may_hold_id(F.col("text"), pack).alias("kept"),
        (F.size(F.regexp_extract_all("text", F.lit(pack.id_pattern), 0)) > 0).alias("hit"),
    )
    assert rows.filter("hit and not kept").count() == 0
    if pack is CONTACT:
        assert rows.filter("kept and not hit").count() == 0


def test_known_ids(spark):
    frame = docs(spark, "see pdb1abc here", "PDB2XYZ", "a 3dEf b", "nothing", "9999")
    known = spark.createDataFrame([("1ABC",), ("3DEF",)], "pdb_id string")
    got = mentions.mentions_known(frame, known, "file_name").collect()
    assert sorted(r[0] for r in got) == ["d0", "d2"]


def test_first_format_and_since(spark):
    rows = [("a", 1, "z.txt", "x1"), ("a", 0, "b.nxml", "x2"), ("a", 0, "c.nxml", "x3"), ("b", 1, "z.txt", "x4")]
    files = spark.createDataFrame(rows, "file_name string, format_rank int, archive string, text string")
    got = mentions.first_format(files).collect()
    assert sorted((r["file_name"], r["archive"]) for r in got) == [("a", "b.nxml"), ("b", "z.txt")]
    updates = spark.sql("select 'a' as file_name, date '2014-01-01' as update_date union all select 'c', date '2016-01-01'")
    kept = mentions.since(files, updates, "2015-01-01").select("file_name").distinct().collect()
    assert [r[0] for r in kept] == ["b"]


def test_two_word_rule_finds_the_same_hits_as_its_plain_form():
    import random
    import re

    from litmine.operators.rules import _ID, PDB

    rule = next(r for r in PDB.rules if r.name == "PDB_SKIP_2").pattern
    plain = rf"\b(?:pdb|PDB)\W*\w+\W*\w+\W*{_ID}\b"
    draw = random.Random(3)
    bits = ["pdb", "PDB", " ", "-", ". ", "1ABC", "2xyz", "foo", "a", "b1", "1999", "_", "pdbfoo1ABC"]
    hits = 0
    for _ in range(20_000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 12)))
        new, old = re.search(rule, text), re.search(plain, text)
        assert (new and new.span()) == (old and old.span()), text
        hits += new is not None
    assert hits > 1_000


def test_long_word_run_takes_linear_time(spark):
    import time

    from litmine.operators.mentions import mine_mentions

    docs = spark.createDataFrame([("a", "pdb " + "x" * 80_000 + ". 1ABC")], "file_name string, text string")
    mine_mentions(docs).count()
    start = time.time()
    assert mine_mentions(docs).count() >= 0
    assert time.time() - start < 5


def test_choice_of_copies_moves_no_text(spark):
    rows = [("a", 0, "x", "No id here."), ("a", 1, "y", "Structure PDB ID: 1ABC was solved."), ("b", 1, "x", "Load 2DEF.pdb now. And more."),
            ("c", 0, "x", None), ("d", 0, "x", "")]
    files = spark.createDataFrame(rows, "file_name string, format_rank int, archive string, text string")
    found = mentions.candidate_sentences(files.repartition(3))
    assert found.select("file_name", "archive").distinct().count() == 5  # a file without an id still counts as a copy
    kept = mentions.first_format(found)
    assert [r["file_name"] for r in mentions.mentions_of_sentences(kept.filter("raw is not null").select("file_name", "raw")).collect()] == ["b"]
    plan = mentions.first_format(mentions.candidate_sentences(files))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert shuffled and not any("text#" in columns for columns in shuffled)
