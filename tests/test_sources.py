import io
import zipfile

import pytest
from pyspark.sql import functions as F

from termloom.sources import atoms, codes, files

ORDER = """\
00001 K35     0 Acute appendix thing                                         Acute appendix thing
00002 K351    1 Acute appendix thing with                                    Acute appendix thing with rupture
00003 K3510   1 short only
00004 R10     1 Belly pain                                                   Belly pain
xx
notanumber K999   1 x
"""
TABULAR = b"""<?xml version="1.0"?><t><chapter><name>11</name><desc>Digestive</desc><section id="K35-K38"><desc>Appendix</desc>
<diag><name>K35</name><desc>d</desc><inclusionTerm><note>inflamed  appendix</note><note>sore appendix</note></inclusionTerm><diag><name>K351</name><desc>e</desc></diag></diag></section></chapter></t>"""
INDEX = b"""<i><letter><mainTerm><title>Attack, attacks</title><term><title>panic <nemod>(mild)</nemod></title><code>F41.0</code></term></mainTerm>
<mainTerm><title>Pain</title><code>R52</code><term><title>belly</title><code>R10.-</code><term><title>upper</title><code>R10.1</code></term><term><title>none</title><see>X</see></term></term></mainTerm></letter></i>"""


@pytest.fixture(scope="module")
def release(tmp_path_factory):
    d = tmp_path_factory.mktemp("release")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b/order-2027.txt", ORDER)
    with zipfile.ZipFile(d / "a.zip", "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("index-2027.xml", INDEX)
    (d / "tabular-2027.xml").write_bytes(TABULAR)
    (d / "z").mkdir()
    (d / "z" / "order-2020.txt").write_text("later by path")
    (d / "latin.txt").write_bytes("caf\xe9\r\nend".encode("cp1252"))
    return str(d)


def test_discovery_and_release(spark, release):
    found = files.find(spark, [release], {"order": r"order-\d{4}\.txt$", "index": r"index.*\.xml$", "tabular": "tabular", "latin": "latin"}).cache()
    assert {r["kind"]: r["name"] for r in found.select("kind", "name").collect()} == {"order": "order-2027.txt", "index": "index-2027.xml", "tabular": "tabular-2027.xml", "latin": "latin.txt"}
    lines = files.lines(found)
    assert [r["line"] for r in lines.filter("kind = 'latin'").orderBy("line_no").collect()] == ["café", "end"]
    got = codes.order_file(lines.filter("kind = 'order'"))
    assert {tuple(r) for r in got.collect()} == {("K35", "Acute appendix thing", False, "category", "condition"), ("K35.1", "Acute appendix thing with rupture", True, "code", "condition"),
                                                ("K35.10", "short only", True, "code", "condition"), ("R10", "Belly pain", True, "category", "symptom")}
    assert {tuple(r) for r in codes.parents_by_prefix(got).collect()} == {("K35.1", "K35"), ("K35.10", "K35.1")}
    tab = {tuple(r) for r in codes.tabular(found.filter("kind = 'tabular'")).collect()}
    assert tab == {("chapter", "CH11", None, "Digestive"), ("block", "K35-K38", None, "Appendix"), ("link", "K35-K38", "CH11", None), ("link", "K35", "K35-K38", None), ("term", "K35", None, "inflamed appendix"), ("term", "K35", None, "sore appendix")}
    idx = {tuple(r) for r in codes.index_terms(found.filter("kind = 'index'")).collect()}
    assert idx == {("F41.0", "Attack, attacks, panic"), ("F41.0", "Attack, panic"), ("R52", "Pain"), ("R10.-", "Pain, belly"), ("R10.1", "Pain, belly, upper")}


def lines_of(spark, text):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(text.split("\n"))], "line_no int, line string")


def test_descriptions_and_crosswalk(spark):
    got, bad = codes.descriptions(lines_of(spark, "0010  Cholera due to x\nV011 Contact\nE8000 Railway\nhello world\n\n0010 Cholera again"))
    assert {tuple(r) for r in got.collect()} == {("001.0", "Cholera again"), ("V01.1", "Contact"), ("E800.0", "Railway")} and bad.count() == 1
    assert {tuple(r) for r in codes.descriptions(lines_of(spark, "4651 Closing\n12 x"), True)[0].collect()} == {("46.51", "Closing")}
    text = "0010  A000  00000\n0020  A0100  10000\n0030  NoDx  11000\n0040  A05  10112\nx y z"
    assert {tuple(r) for r in codes.crosswalk(lines_of(spark, text)).collect()} == {
        ("001.0", "A00.0", "maps_to", False, None), ("002.0", "A01.00", "maps_to_approx", False, None), ("003.0", "NoD.x", "maps_to_approx", True, None), ("004.0", "A05", "maps_to_approx", False, 1)}
    assert codes.crosswalk(lines_of(spark, "A000 0010 00000"), True).first()["icd9"] == "001.0"


def test_atoms(spark, tmp_path):
    row = lambda cui, sab, tty, code, s, aui, lat="ENG", sup="N", isp="Y": f"{cui}|{lat}|P|L|PF|S|{isp}|{aui}|||{''}|{sab}|{tty}|{code}|{s}|0|{sup}||"
    (tmp_path / "MRCONSO.RRF").write_text("\n".join([
        row("C1", "MTH", "PN", "NOCODE", 'Heart "attack"', "A2"), row("C1", "ICD10CM", "PT", "I21", "Infarction", "A1"), row("C1", "CHV", "SY", "x", "heart attack", "A3", isp="N"),
        row("C2", "MSH", "NM", "D1", "dropped type", "A4"), row("C2", "NCI", "PT", "N1", "a gene", "A5"), row("C3", "MTH", "PN", "NOCODE", "French", "A6", lat="FRE"), row("C3", "MTH", "PN", "NOCODE", "gone", "A7", sup="O"),
        row("C1", "SNOMEDCT_US", "SY", "22", "MI second", "A8"), row("C1", "SNOMEDCT_US", "PT", "22", "MI", "A9"), row("C1", "NCI", "AB", "N2", "MI", "B1")]))
    (tmp_path / "MRSTY.RRF").write_text("C1|T184|x|y|z||\nC1|T047|x|y|z||\nC2|T028|x|y|z||\n")
    a = atoms.in_domain(atoms.wanted(atoms.read(spark, str(tmp_path / "MRCONSO.RRF"), atoms.ATOM_COLUMNS)), atoms.domains(atoms.read(spark, str(tmp_path / "MRSTY.RRF"), atoms.TYPE_COLUMNS)))
    assert {(r["AUI"], r["domain"]) for r in a.collect()} == {(x, "condition") for x in ("A1", "A2", "A3", "A8", "A9", "B1")}
    assert [tuple(r) for r in atoms.concepts(a).collect()] == [("C1", 'Heart "attack"')]
    assert {(r["term"], r["term_type"]) for r in atoms.synonyms(a).collect()} == {('Heart "attack"', "clinical"), ("Infarction", "clinical"), ("heart attack", "lay"), ("MI second", "clinical"), ("MI", "clinical"), ("MI", "abbreviation")}
    assert {tuple(r) for r in atoms.source_codes(a).collect()} == {("ICD10CM", "I21", "Infarction"), ("SNOMEDCT_US", "22", "MI")}
    assert [r[0] for r in spark.createDataFrame([("x/2026AA/META",), ("y",)], "p string").select(atoms.version(F.col("p"))).collect()] == ["2026AA", "unknown"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Code , Name\n 1 ,\"a \"\"b\"\"\"\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in files.strict_csv(spark, str(tmp_path / "a.csv"), ["code"]).collect()] == [("1", 'a "b"'), ("2", "")]
    with pytest.raises(ValueError, match="missing columns price"):
        files.strict_csv(spark, str(tmp_path / "a.csv"), ["price"])
    (tmp_path / "c.csv").write_text("# note\nterm,target\n# more\nx,y\n")
    assert [tuple(r) for r in files.commented_csv(spark, str(tmp_path / "c.csv")).collect()] == [("x", "y")]


def test_page_numbers():
    assert files.page_numbers("3-5,9", 20) == [3, 4, 5, 9] and files.page_numbers("12-", 14) == [12, 13, 14] and files.page_numbers(None, 2) == [1, 2]
