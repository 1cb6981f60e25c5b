import io
import tarfile

from pyspark.sql import functions as F

from litmine.plans import workflows
from litmine.sources import archives, metadata, pajek


def test_from_archives_to_reports(spark, tmp_path):
    work = str(tmp_path / "work")
    (tmp_path / "tars").mkdir()
    with tarfile.open(tmp_path / "tars" / "a.tar.gz", "w:gz") as tar:
        for i in range(80):
            kind = ["PDB ID: {} was solved.", "Gene variant ({}) of patients.", "The enzyme {} binds."][i % 3]
            data = kind.format(f"{1 + i % 9}A{chr(65 + i % 26)}{i % 10}").encode()
            info = tarfile.TarInfo(f"d/f{i}.nxml")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    workflows.mine_archives(spark, str(tmp_path / "tars"), f"{work}/{workflows.MENTIONS}")
    files = spark.range(80).selectExpr("concat('P', id) as pmc_id", "cast(id as string) as pm_id", "concat('f', id) as file_name", "date '2015-01-01' as update_date")
    articles = spark.range(80).selectExpr("'J' as journal", "cast(2000 + id % 3 as int) as publication_year", "concat('P', id) as pmc_id")
    found = metadata.read_table(spark, f"{work}/{workflows.MENTIONS}")
    assert found.count() == 80
    entries = found.selectExpr("pdb_id", "substr(file_name, 2) as n").filter("n % 3 <> 1").selectExpr(
        "pdb_id", "case when n % 2 = 0 then concat('P', n) else 'P0' end as pmc_id", "n as pm_id", "2000 as deposition_year", "1 as entry_type").distinct()
    workflows.label(spark, work, files, articles, entries)
    workflows.train(spark, work)
    workflows.predict(spark, work)
    workflows.merge(spark, work)
    reports = workflows.analyse(spark, work, articles)
    total = metadata.read_table(spark, f"{work}/{workflows.DETAILS}").count()
    assert total > 0 and reports["mentions_by_year"].groupBy().sum("mentions").first()[0] == total


def test_networks(spark, tmp_path):
    out = str(tmp_path / "net")
    links = tmp_path / "links.txt"
    links.write_text("* PubMedId || citedin || refs\n1 || 2,3 || \n2 || 3 || 1\n3 ||  || 1,2\n4 || 1,3 || 9\n")
    papers = tmp_path / "papers.txt"
    papers.write_text("* header\n" + "".join(f"{i} || Title {i} || 200{i} || Journal {i % 2} || J{i % 2} || A\n" for i in range(1, 5)))
    workflows.build_networks(spark, str(links), str(papers), out)
    g = pajek.read_network(spark, f"{out}/papers.net")
    assert (g.vertices.count(), g.edges.count()) == (4, 5)
    workflows.cocite(spark, f"{out}/papers.net", f"{out}/co.net")
    lines = [r[0] for r in spark.read.text(f"{out}/co.net").collect()]
    assert lines[0].startswith("*Vertices") and any(x.startswith("*Edges") for x in lines)
    workflows.measure(spark, f"{out}/papers.net", f"{out}/metrics", with_betweenness=True)
    rows = pajek.read_metrics(spark, f"{out}/metrics").collect()
    assert len(rows) == 4 and abs(sum(r["pagerank"] for r in rows) - 1) < 1e-9
    workflows.clean(spark, f"{out}/journals.net", f"{out}/clean.net")
    assert pajek.read_network(spark, f"{out}/clean.net").edges.count() == 2


def test_a_later_run_replaces_the_rows_of_its_files(spark, tmp_path):
    out = str(tmp_path / "mentions")

    def archive(name, entries):
        (tmp_path / name).mkdir()
        with tarfile.open(tmp_path / name / "a.tar.gz", "w:gz") as tar:
            for entry, text in entries.items():
                info = tarfile.TarInfo(entry)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
        return str(tmp_path / name)

    def found():
        return sorted((r["file_name"], r["pdb_id"]) for r in metadata.read_table(spark, out).collect())

    first = archive("first", {"d/a.nxml": "See PDB ID: 1ABC here.", "d/a.txt": "See PDB ID: 9XYZ here.", "d/b.nxml": "See PDB ID: 2DEF here."})
    workflows.mine_archives(spark, first, out)
    assert found() == [("a", "1ABC"), ("b", "2DEF")]
    later = archive("later", {"d/a.nxml": "See PDB ID: 3GHI here.", "d/b.nxml": "See PDB ID: 4JKL here.", "d/c.nxml": "None."})
    files = spark.createDataFrame([("a", "2016-02-01"), ("b", "2015-01-01")], "file_name string, day string").selectExpr("file_name", "to_date(day) as update_date")
    for _ in range(2):
        workflows.mine_archives(spark, later, out, files, "2016-01-01")
        assert found() == [("a", "3GHI"), ("b", "2DEF")]
    gone = archive("gone", {"d/a.nxml": "No id any more."})
    workflows.mine_archives(spark, gone, out, files, "2016-01-01")
    assert found() == [("b", "2DEF")]


def test_old_articles_are_not_decoded(spark, tmp_path):
    (tmp_path / "tars").mkdir()
    for part in range(3):
        with tarfile.open(tmp_path / "tars" / f"{part}.tar.gz", "w:gz") as tar:
            for i in range(part, 90, 3):
                for kind in ("nxml", "txt"):
                    info = tarfile.TarInfo(f"d/f{i}.{kind}")
                    info.size = len(f"text {i}")
                    tar.addfile(info, io.BytesIO(f"text {i}".encode()))
    old = spark.range(60).selectExpr("concat('f', id) as file_name")
    folder = str(tmp_path / "tars")
    read = archives.read_archives(spark, folder, skip=archives.name_filter(old)).collect()
    decoded = {r["file_name"] for r in read if r["text"] is not None}
    assert len(read) == 180 and decoded == {f"f{i}" for i in range(60, 90)} and all((r["text"] is None) == r["deferred"] for r in read)

    # A filter that is too small says yes to nearly all names; the exact join brings the new ones back, each read once.
    tiny = archives.name_filter(old, size=64, hashes=1)
    assert all(f"f{i}" in tiny for i in range(60)) and sum(f"f{i}" in tiny for i in range(60, 90)) > 10
    usual, archives.name_filter = archives.name_filter, lambda names: usual(names, size=64, hashes=1)
    try:
        found = archives.read_except(spark, folder, old, lambda e: e.withColumn("n", F.length("text")).drop("text")).collect()
    finally:
        archives.name_filter = usual
    want = {(f"d/f{i}.{kind}", f"f{i}", kind, 7) for i in range(60, 90) for kind in ("nxml", "txt")}
    assert len(found) == 60 and {(r["entry_name"], r["file_name"], r["format"], r["n"]) for r in found} == want


def test_names_of_every_kind_in_the_filter(spark):
    names = [f"Journal_{i}_é日" for i in range(500)] + ["", None]
    held = archives.name_filter(spark.createDataFrame([(n,) for n in names], "file_name string"))
    assert all(n in held for n in names[:-1]) and sum(f"other {i}" in held for i in range(2000)) == 0
