import datetime as dt

import pytest
from pyspark.sql import functions as F

from termloom.sources import codes as C
from termloom.sources import load as L


def lines(spark, *text):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(text)], "line_no int, line string")


def table(spark, names, *rows):
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "line int, " + ", ".join(f"{n} string" for n in names.split()))


def order(spark, *codes):
    return C.order_file(lines(spark, *[f"{i:05d} {c:<7} {flag} {name:<60} {name}" for i, (c, flag, name) in enumerate(codes, 1)]))


def concept(store, vocabulary):
    return {r["code"]: r for r in store.concept.filter(F.col("vocabulary_id") == vocabulary).collect()}


def test_releases_of_icd10(spark):
    tab = spark.createDataFrame([("chapter", "CH01", None, "All"), ("block", "Q10-Q19", None, "Some"), ("link", "Q10-Q19", "CH01", None), ("link", "Q10", "Q10-Q19", None), ("term", "Q10.1", None, "Bent toe")], "row string, code string, parent string, text string")
    index = spark.createDataFrame([("Q10.1-", "Toe, bent"), ("Z99", "Nothing")], "code string, term string")
    store, n = L.icd10(L.Store.empty(spark), order(spark, ("Q10", 0, "Toes"), ("Q101", 1, "Toe bent"), ("Q102", 1, "Toe lost")), tab, index, 2031)
    assert (n["codes"], n["billable"], n["new"], n["missing"]) == (5, 2, 5, 0)
    ids = {c: r["concept_id"] for c, r in concept(store, "ICD10CM").items()}
    back = {v: k for k, v in ids.items()}
    up = {(back[r["concept_id_1"]], back[r["concept_id_2"]]) for r in store.edge.filter("relationship_id = 'is_a'").collect()}
    assert up == {("Q10.1", "Q10"), ("Q10.2", "Q10"), ("Q10", "Q10-Q19"), ("Q10-Q19", "CH01")} and store.edge.count() == 8
    assert {(back[r["concept_id"]], r["term"], r["term_type"]) for r in store.synonym.filter("term_type <> 'preferred'").collect()} == {("Q10.1", "Bent toe", "clinical"), ("Q10.1", "Toe, bent", "index")}
    store, n = L.icd10(store, order(spark, ("Q10", 0, "Toes"), ("Q102", 1, "Toe gone"), ("Q103", 1, "Toe new")), year=2032)
    now = concept(store, "ICD10CM")
    assert now["Q10.1"]["valid_end"] == dt.date(2031, 9, 30) and now["Q10.3"]["valid_start"] == dt.date(2031, 10, 1) and now["CH01"]["valid_end"] is None
    assert now["Q10.2"]["name"] == "Toe gone" and all(now[c]["concept_id"] == i for c, i in ids.items()) and [tuple(r) for r in store.vocabulary.collect()] == [("ICD10CM", "2032")]
    store, _ = L.icd10(store, order(spark, ("Q10", 0, "Toes"), ("Q101", 1, "Toe bent")), year=2033)
    assert concept(store, "ICD10CM")["Q10.1"]["valid_end"] is None
    with pytest.raises(FileNotFoundError):
        L.icd10(store, None)


def test_icd9_with_crosswalk(spark):
    store, _ = L.icd10(L.Store.empty(spark), order(spark, ("Q10", 1, "Toes"), ("R11", 1, "Odd")), year=2031)
    dx, _ = C.descriptions(lines(spark, "7001 Toe trouble", "V101 History of toes", "rubbish"))
    pr, _ = C.descriptions(lines(spark, "8401 Toe removal"), True)
    walk = C.crosswalk(lines(spark, "7001 Q10 10000", "7001 R11 00112", "V101 NoDx 11000", "7001 S99 00000"))
    store, n = L.icd9(store, dx, pr, walk)
    assert n == {"codes": 3, "maps_to": 1, "maps_to_approx": 1, "no_map": 1, "not_loaded": 1}
    got = concept(store, "ICD9CM")
    assert {c: r["domain"] for c, r in got.items()} == {"700.1": "condition", "V10.1": "observation", "84.01": "procedure"}
    assert store.edge.filter("source = 'CMS_GEM'").count() == 4 and {r["map_priority"] for r in store.edge.filter("relationship_id = 'maps_to'").collect()} == {1}
    again, _ = L.icd9(store, dx, pr, walk)
    assert again.edge.count() == store.edge.count() and again.concept.count() == store.concept.count()


def test_umls(spark):
    cols = "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()
    atom = lambda cui, aui, sab, tty, code, term: (cui, "ENG", "P", "L", "PF", "S", "Y", aui, "", "", "", sab, tty, code, term, "0", "N", "")
    make = lambda *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols))
    types = spark.createDataFrame([("C1", "T047"), ("C2", "T184")], "CUI string, TUI string")
    store, _ = L.icd10(L.Store.empty(spark), order(spark, ("Q10", 1, "Toes")), year=2031)
    a, b = atom("C1", "A1", "MTH", "PN", "NOCODE", "Toe disease"), atom("C1", "A2", "ICD10CM", "PT", "Q10", "Toes")
    store, n = L.umls(store, make(a, b, atom("C2", "A3", "CHV", "SY", "x", "sore toe")), types, dt.date(2031, 5, 1), "2031AA")
    assert (n["concepts"], n["links"], n["retired"]) == (2, 1, 0) and {r["domain"] for r in store.concept.filter("vocabulary_id = 'UMLS'").collect()} == {"condition", "symptom"}
    assert store.edge.filter("relationship_id = 'umls_cui_of'").count() == 1 and store.synonym.filter("term_type = 'lay'").count() == 1
    store, n = L.umls(store, make(a, b), types, dt.date(2031, 11, 1), "2031AB")
    assert n["retired"] == 1 and concept(store, "UMLS")["C2"]["valid_end"] == dt.date(2031, 11, 1)
    assert ("UMLS", "2031AB") in {tuple(r) for r in store.vocabulary.collect()}


NAMES = "code description units amount fee_note modifier effective_start"


def test_fees(spark):
    rows = table(spark, NAMES, ("71.1", "Toe visit", "4", "", "", "", "2030-01-01"), ("71.1", "Toe visit", "9", "", "", "", "2030-01-01"), ("71.1", "", "5", "", "", "LO=X", ""), ("72.2B", "Toe  surgery", "", "$1,200.50", "", "", "2030-02-01"),
                 ("72.2B", "Surgery of toe", "1", "", "", "", "2030-03-01"), ("", "no code", "bad", "", "", "", ""))
    store, n = L.fees(L.Store.empty(spark), rows, "P", "FEE", dt.date(2029, 1, 1))
    assert n == {"codes": 2, "fees": 4, "conflicts": 1, "terminated": 0}
    assert {c: r["name"] for c, r in concept(store, "FEE").items()} == {"71.1": "Toe visit", "72.2B": "Toe  surgery"}
    assert {str(r["amount"]) for r in store.fee.filter("amount is not null").collect()} == {"1200.50"} and store.synonym.count() == 3
    log = table(spark, NAMES + " action", ("71.1", "Other name", "6", "", "", "", "2031-01-01", "updated"), ("72.2B", "", "", "", "", "", "2031-06-01", "terminated"), ("71.1", "", "", "", "", "", "2030-06-01", "terminated"))
    store, n = L.fees(store, log, "P", "FEE")
    now = concept(store, "FEE")
    assert n["terminated"] == 2 and now["72.2B"]["valid_end"] == dt.date(2031, 6, 1) and now["71.1"]["valid_end"] is None and now["71.1"]["name"] == "Toe visit"
    assert {r["term_type"] for r in store.synonym.filter("source = 'P_BULLETINS'").collect()} == {"clinical"}
    units = table(spark, "unit_name effective_start effective_end amount_per_unit", ("MSU", "2030-01-01", "2030-12-31", "2.5"), ("MSU", "2031-01-01", "", "$2.75"))
    store, n = L.unit_values(store, units, "P")
    worth = {(r["modifier"], str(r["units"]), str(r["units_rate"])) for r in L.priced(store, F.lit("2031-03-01").cast("date"), {"units": "MSU"}).collect() if r["units"] is not None}
    assert n == {"unit_values": 2} and worth == {("", "6.00", "2.7500"), ("LO=X", "5.00", "2.7500"), ("", "1.00", "2.7500")}


@pytest.mark.parametrize("row,message", [(("1", "x", "abc", "", "", "", "2030-01-01"), "line 2: bad units abc"), (("1", "x", "1", "", "", "", "01/02/2030"), "line 2: bad effective_start"), (("1", "x", "1", "", "", "", ""), "line 2: no effective_start"),
                                         (("1", "x", "", "", "", "", "2030-01-01"), "line 2: no value")])
def test_bad_rows_name_their_line(spark, row, message):
    with pytest.raises(ValueError, match=message):
        L.fees(L.Store.empty(spark), table(spark, NAMES, row), "P", "FEE")


def test_code_list_and_versions(spark, tmp_path):
    store, _ = L.icd10(L.Store.empty(spark), order(spark, ("Q10", 1, "Toes")), year=2031)
    store, n = L.code_list(store, table(spark, "code description maps_to", ("D1", "Toe", "Q10"), ("D2", "Heel", "Q99"), ("D1", "Toe again", "Q10")), "DX", "ICD10CM")
    assert n == {"codes": 2, "maps_to": 1, "target_not_loaded": 1} and concept(store, "DX")["D1"]["name"] == "Toe again"
    at = str(tmp_path / "store")
    assert not L.Store.exists(spark, at)
    store.write(at, "v1")
    L.stamp(store, "DX", "2").write(at, "v2")
    assert L.Store.exists(spark, at) and L.Store.read(spark, at).vocabulary.count() == 2
