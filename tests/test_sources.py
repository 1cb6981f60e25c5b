import datetime as dt
import io
import tarfile

import pytest

from litmine import schemas
from litmine.functions.fields import header_date, snake_case, tree_parent, tree_path
from litmine.operators import graph, mesh
from litmine.operators.graph import Graph
from litmine.sources import archives, links, mesh_files, metadata, pajek
from pyspark.sql import functions as F


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_file_list(spark, tmp_path):
    path = put(tmp_path, "file_list.csv", (
        "File,Article Citation,Accession ID,Last Updated (YYYY-MM-DD HH:MM:SS),PMID\n"
        '08/e0/Breast_Cancer_Res_2001_Nov_2_3(1)_55-60.tar.gz,"Breast Cancer Res. 2001, 3",PMC13900,2013-03-20 11:19:30,11250746\n'
        "ab/cd/x.tar.gz,c,PMC2,nonsense,\n"
    ))
    a, b = sorted(metadata.read_files(spark, path).collect(), key=lambda r: r["pmc_id"])
    assert a.asDict() == dict(pmc_id="PMC13900", pm_id="11250746", update_date=dt.date(2013, 3, 20),
                              file_name="Breast_Cancer_Res_2001_Nov_2_3(1)_55-60")
    assert (b["update_date"], b["pm_id"]) == (None, None)


def test_articles(spark, tmp_path):
    path = put(tmp_path, "ids.csv", ",".join(metadata.ARTICLE_LIST) + "\n" + 'Nature,1999,1,2,3,d,PMC1,7,,live\n"A, B",x,,,,,PMC2,,,\n')
    rows = {r["pmc_id"]: (r["journal"], r["publication_year"]) for r in metadata.read_articles(spark, path).collect()}
    assert rows == {"PMC1": ("Nature", 1999), "PMC2": ("A, B", None)}


def test_entries(spark, tmp_path):
    current = put(tmp_path, "cur.csv", '"structureId","pmc","pubmedId","depositionDate"\n"1ABC","PMC1","11","2001-02-03"\n'
                  '"2XYZ","","","1999-12-31"\n"3BAD","","","19"\n"4BAD","","","abcd-01-01"\n')
    rows = {r["pdb_id"]: r for r in metadata.read_current_entries(spark, current).collect()}
    assert set(rows) == {"1ABC", "2XYZ"}
    assert rows["1ABC"]["deposition_date"] == dt.date(2001, 2, 3) and rows["1ABC"]["entry_type"] == schemas.CURRENT
    assert rows["2XYZ"]["pmc_id"] is None and rows["2XYZ"]["pm_id"] is None

    text = put(tmp_path, "unreleased.xml", '<r structureId="5AAA" initialDepositionDate="2010-01-02"/>\n'
               '<r structureId="5BBB" initialDepositionDate="soon"/>\n<other/>\n')
    rows = {r["pdb_id"]: r["deposition_year"] for r in metadata.read_unreleased_entries(spark, text).collect()}
    assert rows == {"5AAA": 2010, "5BBB": None}

    line = "HEADER    HYDROLASE".ljust(50) + "12-MAR-85   1abc      "
    header = put(tmp_path, "h.ent", line + "\n" + line.replace("85", "07").replace("1abc", "2xyz") + "\n")
    rows = {r["pdb_id"]: r for r in metadata.read_header_entries(spark, header, schemas.CURRENT_MODEL).collect()}
    assert rows["1ABC"]["deposition_date"] == dt.date(1985, 3, 12)
    assert rows["2XYZ"]["deposition_year"] == 2007 and rows["2XYZ"]["entry_type"] == 5


@pytest.mark.parametrize("text,want", [("01-Jan-36", 2036), ("01-Jan-37", 1937), ("31-DEC-99", 1999), ("1-Jan-99", None)])
def test_two_digit_years(spark, text, want):
    frame = spark.createDataFrame([(text,)], "x string")
    got = frame.select(F.year(header_date(F.col("x"), dt.date(2016, 1, 1))).alias("y")).first()["y"]
    assert got == want


def test_small_lists(spark, tmp_path):
    external = put(tmp_path, "e.csv", "src,PMCID:PMC12\nPMCID:PMC13\n")
    assert sorted(r[0] for r in metadata.read_external_mentions(spark, external).collect()) == ["PMC12", "PMC13"]
    seeds = put(tmp_path, "s.csv", '"PDB ID","PubMed ID"\n"1ABC","77"\n"2XYZ",""\n')
    assert [tuple(r) for r in metadata.read_id_papers(spark, seeds).collect()] == [("1ABC", 77)]
    drugs = put(tmp_path, "d.csv", '"Generic Name",a,b,c,d,e,p,s,p,s,p,s\n"x, y",1,2,3,4,5,"1ABC","95%","","","",""\n')
    row = metadata.read_drugs(spark, drugs).first()
    assert (row["generic_name"], row["pdb_id_1"], row["sim_1"], row["pdb_id_2"]) == ("x, y", "1ABC", "95%", "")
    report = put(tmp_path, "r.csv", "structureId,pubmedId\n1ABC,7\n")
    assert metadata.read_report(spark, report).columns == ["structure_id", "pubmed_id"]


def test_names():
    assert [snake_case(x) for x in ("pdbId", "blindedSentence", "Release Date", "x")] == ["pdb_id", "blinded_sentence", "release_date", "x"]


def test_archives(spark, tmp_path):
    for number in range(3):
        with tarfile.open(tmp_path / f"part{number}.tar.gz", "w:gz") as tar:
            for k in range(5):
                data = f"text {number} {k} é".encode()
                info = tarfile.TarInfo(f"Dir/a{number}{k}.{'nxml' if k % 2 else 'txt'}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (tmp_path / "readme.md").write_text("no archive")
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 15
    row = next(r for r in rows if r["file_name"] == "a13")
    assert (row["format"], row["text"], row["archive"].split("/")[-1]) == ("nxml", "text 1 3 é", "part1.tar.gz")


def test_link_xml(spark, tmp_path):
    path = put(tmp_path, "l.xml", """<?xml version="1.0"?><eLinkResult>
<LinkSet><DbFrom>pubmed</DbFrom><IdList><Id>1</Id></IdList>
 <LinkSetDb><DbTo>pubmed</DbTo><LinkName>pubmed_pubmed_citedin</LinkName><Link><Id>5</Id></Link><Link><Id>6</Id></Link></LinkSetDb>
 <LinkSetDb><DbTo>pubmed</DbTo><LinkName>pubmed_pubmed_refs</LinkName><Link><Id>7</Id></Link></LinkSetDb></LinkSet>
<LinkSet><DbFrom>pubmed</DbFrom><IdList><Id>2</Id></IdList></LinkSet></eLinkResult>""")
    sets = links.read_link_xml(spark, path)
    assert sorted((r["pubmed_id"], r["cited_in"], r["refs"]) for r in sets.collect()) == [(1, [5, 6], [7]), (2, [], [])]
    links.write_link_text(sets, str(tmp_path / "text"))
    back = links.read_link_text(spark, str(tmp_path / "text")).collect()
    assert sorted((r["pubmed_id"], r["cited_in"], r["refs"]) for r in back) == [(1, [5, 6], [7]), (2, [], [])]


def test_summary_xml(spark, tmp_path):
    path = put(tmp_path, "s.xml", """<eSummaryResult><DocSum><Id>9</Id><Item Name="PubDate" Type="Date">2010 Mar 3</Item>
<Item Name="AuthorList" Type="List"><Item Name="Author" Type="String">A B</Item></Item>
<Item Name="LastAuthor" Type="String">Z Y</Item><Item Name="Title" Type="String">On x &amp; y</Item>
<Item Name="NlmUniqueID" Type="String">2984771R</Item><Item Name="FullJournalName" Type="String">J</Item></DocSum></eSummaryResult>""")
    papers = links.read_summary_xml(spark, path)
    want = (9, "On x & y", 2010, "J", "2984771R", "Z Y")
    assert tuple(papers.first()) == want
    links.write_summary_text(papers, str(tmp_path / "t"))
    assert tuple(links.read_summary_text(spark, str(tmp_path / "t")).first()) == want


def test_edge_list(spark, tmp_path):
    path = put(tmp_path, "e.txt", "a b\na\t b\nb  c\n\n")
    assert sorted(tuple(r) for r in links.read_edge_list(spark, path).collect()) == [("a", "b"), ("b", "c")]


EXAMPLE = """*Vertices 3
1 "Name of first node" 1.0
2 "Name of "second" node" 2.0
3 "Third"
*Arcs 4
1 2 1.0
1 3 1.7
2 3 -2.0
3 2
"""


def test_pajek(spark, tmp_path):
    g = pajek.read_network(spark, put(tmp_path, "a.net", EXAMPLE))
    assert sorted(tuple(r) for r in g.vertices.collect()) == [
        (1, "Name of first node", 1.0), (2, 'Name of "second" node', 2.0), (3, "Third", 1.0)]
    assert sorted(tuple(r) for r in g.edges.collect()) == [(1, 2, 1.0), (1, 3, 1.7), (2, 3, 1.0), (3, 2, 1.0)]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (g.vertices, g.edges)]
    assert not [p for p in plans if "FileScan text" in p]  # the text was read once, by the copy
    with pytest.raises(ValueError):
        pajek.read_network(spark, put(tmp_path, "b.net", EXAMPLE.replace("Arcs 4", "Arcs 5")))
    out = str(tmp_path / "out.net")
    pajek.write_network(graph.number_vertices(g), out)
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert lines[0] == "*Vertices 3" and "*Arcs 4" in lines and lines[1] == '1 "Name of first node"'
    assert lines.index("*Arcs 4") == 4 and lines[5:] == ["1 2 1.0", "1 3 1.7", "2 3 1.0", "3 2 1.0"]


def test_metrics_file(spark, tmp_path):
    rows = [(1, 2, 3, 0.25, 1.5, "a || b || c")]
    frame = spark.createDataFrame(rows, "id long, in_degree long, out_degree long, pagerank double, betweenness double, name string")
    pajek.write_metrics(frame, str(tmp_path / "m"))
    assert tuple(pajek.read_metrics(spark, str(tmp_path / "m")).first()) == rows[0]


DESCRIPTORS = """*NEWRECORD
RECTYPE = D
MH = Calcimycin
ENTRY = A-23187|T109|T195|LAB
ENTRY = Plain
MN = D03.438.221.173
MN = D02.355
UI = D000001
*NEWRECORD
MH = Male
UI = D008297
"""


def test_mesh(spark, tmp_path):
    read = mesh_files.read_descriptors(spark, put(tmp_path, "mesh.bin", DESCRIPTORS))
    rows = {r["ui"]: r for r in read.collect()}
    assert len(rows) == 1 + 17 and "D008297" not in rows
    assert rows["D000001"]["terms"] == ["Calcimycin", "A-23187"]
    assert rows["D000001"]["mns"] == ["D03.438.221.173", "D02.355"]
    assert rows["U00"]["mh"] == "ROOT-SCIENCE"
    report = put(tmp_path, "p.csv", '"PDB ID","Year","PMC","PM","Mesh"\n"1ABC","2000","P1","1","Calcimycin, Other"\n"2ABC","","","",""\n')
    reports = mesh_files.read_term_report(spark, report)
    assert {r["pdb_id"]: r["terms"] for r in reports.collect()} == {"1ABC": ["Calcimycin", "Other"], "2ABC": []}
    found, counts = mesh.match_terms(reports, read)
    assert [tuple(r) for r in found.collect()] == [("1ABC", "D000001")]
    assert tuple(counts.first()) == (1, 1)


def test_tree(spark):
    frame = spark.createDataFrame([("0",), ("A",), ("A01",), ("A01.2.3",)], "mn string")
    got = {r["mn"]: (r["p"], r["path"]) for r in frame.select("mn", tree_parent(F.col("mn")).alias("p"), tree_path(F.col("mn")).alias("path")).collect()}
    assert got == {
        "0": ("", ["0"]), "A": ("0", ["A", "0"]), "A01": ("A", ["A01", "A", "0"]),
        "A01.2.3": ("A01.2", ["A01", "A01.2", "A01.2.3", "A", "0"]),
    }


def test_tree_report(spark):
    rows = [("u0", "R", ["0"]), ("ua", "A", ["A"]), ("u1", "x", ["A01"]), ("u2", "y", ["A01.1", "A01.2"])]
    d = spark.createDataFrame([(u, h, m, [h]) for u, h, m in rows], "ui string, mh string, mns array<string>, terms array<string>")
    used = spark.createDataFrame([("p1", "u2"), ("p2", "u1"), ("p1", "u1")], "pdb_id string, ui string")
    report = {r["mn"]: (r["direct"], r["cumulative"], r["children"], r["descendants"]) for r in mesh.tree_report(mesh.tree_links(d), used).collect()}
    assert report == {"0": (0, 2, 1, 4), "A": (0, 2, 1, 3), "A01": (2, 2, 2, 2), "A01.1": (1, 1, 0, 0), "A01.2": (1, 1, 0, 0)}
    g = mesh.tree_graph(mesh.tree_report(mesh.tree_links(d), used))
    assert isinstance(g, Graph) and g.edges.count() == 4
    assert g.vertices.filter("id = 'A01'").first()["name"] == "x [A01] | 2 | 2"


def test_names_of_file_systems():
    from litmine.sources.archives import _uri

    assert _uri("s3a://bucket/a.tar.gz") == "s3://bucket/a.tar.gz"
    assert _uri("dbfs:/x/a.tar.gz") == "file:///dbfs/x/a.tar.gz"
    assert _uri("file:/x/a.tar.gz") == "file:///x/a.tar.gz" and _uri("hdfs://n/a") == "hdfs://n/a"


def test_archives_grow_in_number(spark, tmp_path):
    from litmine.plans import formats

    docs = spark.range(100).select(F.concat(F.lit("a/x"), "id", F.lit(".txt")).alias("entry_name"), F.repeat(F.lit("ab"), 500).alias("text"))
    assert formats.archive_count(docs, 8) == formats.archive_count(docs.limit(0), 8) == 8
    assert formats.archive_count(docs, 8, size=5_000) == 20
    path = formats.archives(docs, str(tmp_path / "t"), formats.archive_count(docs, 8, size=5_000))
    rows = archives.read_archives(spark, path).select("archive", "entry_name").collect()
    assert len({r["entry_name"] for r in rows}) == len(rows) == 100 and len({r["archive"] for r in rows}) > 8
