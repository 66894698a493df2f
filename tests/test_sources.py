import json
import tomllib

import pytest
import zstandard
from kinmark import cli
from kinmark.functions.citations import TEI_URI, citation, tei_document
from kinmark.operators.closest import releases_of_citations
from kinmark.operators.cluster import verify_clusters
from kinmark.sources import io
from kinmark.streaming.verify_stream import read_cluster_stream, verify_stream
from pyspark.sql import functions as F

TITLE = "A title that is long enough"
DOC = {"k": "x", "v": [{"ident": "a", "title": TITLE, "release_year": "1999", "contribs": [{"raw_name": "N"}]}, {"ident": "b", "title": TITLE, "release_year": 2000, "contribs": [{"raw_name": "N"}]}]}


def test_clusters_and_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(DOC) + "\n\n" + json.dumps({"k": "y", "v": []}) + "\n")
    pairs = verify_clusters(io.read_clusters(spark, str(tmp_path / "c.json")))
    assert [r.value for r in io.pair_lines(pairs, "r/").collect()] == ["r/a r/b Status.EXACT Reason.TITLE_AUTHOR_MATCH"]
    (tmp_path / "bad.json").write_text('{"k": "x"}\n')
    with pytest.raises(Exception, match="without v"):
        io.read_clusters(spark, str(tmp_path / "bad.json")).collect()
    assert io.read_clusters(spark, str(tmp_path / "bad.json"), strict=False).count() == 0


def test_zstd_lines(spark, tmp_path):
    text = "\n".join(["first", "", "é" * 70_000, "last without newline"])
    (tmp_path / "l.zst").write_bytes(zstandard.compress(text.encode()))
    (tmp_path / "e.zst").write_bytes(zstandard.compress(b""))
    got = io.read_zstd_lines(spark, str(tmp_path / "*.zst")).orderBy("line_no").collect()
    assert [r.line for r in got] == text.split("\n")


def test_toml_and_json(spark):
    doc = {"title": 'A "q"\n', "n": 3, "ok": True, "list": [1, 2], "ids": {"doi": "10.1/x"}, "gone": None, "drop": 1}
    df = spark.createDataFrame([(json.dumps(doc),), (None,)], "j string").select(io.json_to_toml("j", ("drop",)).alias("t"))
    text = df.first().t
    assert tomllib.loads(text) == {k: v for k, v in doc.items() if k not in ("gone", "drop")}
    assert json.loads(df.select(io.toml_to_json("t").alias("j")).first().j)["ids"] == {"doi": "10.1/x"}
    assert spark.createDataFrame([("a = ",)], "t string").select(io.toml_to_json("t").alias("j")).first().j is None


def test_citation(spark):
    xml = """<biblStruct xmlns="URI" xml:id="b0"><analytic><title level="a">On <hi>it</hi></title><author><persName><forename>A</forename><surname>Lee</surname></persName>
      <affiliation><orgName type="institution">U</orgName><address><country>X</country></address></affiliation></author><author><persName/></author><idno type="DOI">10.5/A</idno><idno type="arXiv">arXiv:12.3</idno></analytic>
      <monogr><title>J</title><imprint><publisher>P</publisher><biblScope unit="volume">2</biblScope><biblScope to='9' from='3' unit='page'/><date when='2019-01' type='published'/></imprint></monogr><ptr target="&lt;http://a.b&gt; x"/></biblStruct>""".replace("URI", TEI_URI)
    rows = spark.createDataFrame([("1", xml), ("2", "<biblStruct/>"), ("3", "not xml"), ("4", None), ("5", "<b><monogr><title>Whole</title></monogr></b>")], "ident string, x string").select("ident", citation("x").alias("ref"))
    got = {r.ident: r.ref for r in rows.collect()}
    r = got["1"]
    assert (r.id, r.title, r.journal, r.publisher, r.pages, r.arxiv_id, r.url, r.date) == ("b0", "On ", "J", "P", "3-9", "12.3", "http://a.b", "2019-01")
    assert [(a.name, a.surname, a.affiliation.institution, a.affiliation.address) for a in r.authors] == [("A Lee", "Lee", "U", {"country": "X"})]
    assert got["2"] is got["3"] is got["4"] is None and got["5"].title == "Whole" and got["5"].journal is None
    rel = {x.ident: x for x in releases_of_citations(rows).collect()}
    assert rel["1"].release_year == 2019 and rel["1"].ext_ids.doi == "10.5/a" and rel["1"].contribs[0].raw_name == "A Lee" and set(rel) == {"1", "5"}


def test_tei_document(spark):
    xml = '<TEI xmlns="URI"><teiHeader><appInfo><application version=" 0.5 " when="t"/></appInfo><sourceDesc><biblStruct><analytic><title>T</title></analytic></biblStruct></sourceDesc><idno type="DOI">10.1/X</idno></teiHeader><text xml:lang="en"><body><p>one</p><p>two</p></body><back><div type="annex"><p>z</p></div><listBibl><biblStruct><monogr><title>R</title></monogr></biblStruct></listBibl></back></text></TEI>'.replace("URI", TEI_URI)
    df = spark.createDataFrame([(xml,), ("<x/>",)], "x string")
    d, none = (r.d for r in df.select(tei_document("x").alias("d")).collect())
    assert (d.title, d.doi, d.grobid_version, d.body, d.annex, d.language_code, d.abstract) == ("T", "10.1/x", "0.5", "one two", "z", "en", None) and none is None
    assert [(c["index"], c.title) for c in d.citations] == [(0, "R")]
    assert df.select(tei_document("x", encumbered=False).alias("d")).first().d.body is None


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"in{i}.json").write_text(json.dumps(DOC | {"k": str(i)}) + "\n")
    q = verify_stream(read_cluster_stream(spark, f"{tmp_path}/in*.json", 1), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True)
    q.awaitTermination(120)
    want = verify_clusters(io.read_clusters(spark, f"{tmp_path}/in*.json"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 3 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_commands(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(DOC) + "\n")
    (tmp_path / "r.json").write_text("".join(json.dumps(r) + "\n" for r in DOC["v"]))
    (tmp_path / "x.xml").write_text(f"<b><analytic><title>{TITLE}</title></analytic></b>")
    run = lambda *a: sorted(r.value for r in cli.plan(spark, cli.parser().parse_args([str(x) for x in a])).collect())
    assert run("verify", "-f", tmp_path / "c.json") == ["a b Status.EXACT Reason.TITLE_AUTHOR_MATCH"]
    assert run("verify", "-f", tmp_path / "c.json", "--counts") == ["title_author_match\t1", "total\t1"]
    assert json.loads(run("cluster", "-f", tmp_path / "r.json")[0])["k"] == "a title that is long enough"
    assert json.loads(run("verify_single", "--catalog", tmp_path / "r.json", "-a", "b", "-b", "a")[0]) == {"extra": {"q": "verify"}, "a": "b", "b": "a", "r": ["exact", "title_author_match"]}
    assert len(run("verify_single", "--catalog", tmp_path / "r.json")) == 1
    with pytest.raises(SystemExit):
        run("verify_single", "--catalog", tmp_path / "r.json", "-a", "b")
    assert run("release_match", "--catalog", tmp_path / "r.json", "--value", TITLE) == [f"{i}\t\t\t{TITLE}" for i in "ab"]
    assert json.loads(run("release_match", "--catalog", tmp_path / "r.json", "--json", "--value", TITLE)[0])["match_count"] == 2
    assert run("unstructured", "--catalog", tmp_path / "r.json", "-f", tmp_path / "x.xml") == ["AMBIGUOUS\tUNKNOWN\ta"]
    assert run("verify_ref", "-f", tmp_path / "c.json") == []
