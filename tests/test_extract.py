"""A price list of a garden nursery, a plant code list and a bulletin: layouts of our own."""

import datetime as dt

import pytest

from termloom.functions import text as X
from termloom.operators import extract as E
from termloom.sources import sinks

SCHEMA = f"doc_id string, page int, line_no int, top double, words array<{E.WORD}>"
NURSERY = E.Layout(record=r"(P-\d{3})(?=\s|$)", columns={"pot": (300, 349), "tray": (350, 420)}, record_max_x=30, heading=r"[A-Z]{4,}(?: [A-Z]{4,})*", heading_max_x=30,
                   page_section=r"^Glasshouse (\w+)$", modifier=r"#[a-z]+", skip=(r"^Spring list$",), value=r"\d+(?:\.\d+)?(?:/wk)?|ask")


def page(number, *rows):
    """Rows of (x of the first word, text; further (x, text) pairs); every character is 4 wide, a blank 2."""
    out = []
    for n, row in enumerate(rows, 1):
        words = []
        for x, text in row:
            for w in text.split():
                words.append((float(x), x + 4.0 * len(w), w))
                x += 4 * len(w) + 2
        out.append(("list", number, n, 14.0 * n, words))
    return out


PRICES = (page(1, [(120, "Spring list")], [(10, "FERNS")], [(10, "P-100"), (60, "Royal fern ..."), (305, "7.5"), (360, "40")], [(60, "#large grown slowly ..."), (305, "11/wk")],
               [(10, "P-101"), (60, "Hart's tongue,")], [(60, "evergreen ..."), (305, "ask")], [(10, "P-102"), (60, "Sold out this year")], [(8, "closed on Sundays")], [(120, "Glasshouse East")])
          + page(2, [(10, "ROSES RAMBLING")], [(10, "P-200"), (60, "Old rose, 40 petals"), (355, "90")], [(120, "Glasshouse West")]))


def test_records(spark):
    got, empty, left = E.records(spark.createDataFrame(PRICES, SCHEMA), NURSERY)
    rows = {(r["code"], r["modifier"]): (r["description"], r["values"], r["heading"], r["section"], r["page"]) for r in got.collect()}
    assert rows == {("P-100", ""): ("Royal fern", {"pot": "7.5", "tray": "40"}, "FERNS", "East", 1), ("P-100", "#large"): ("Royal fern grown slowly", {"pot": "11/wk"}, "FERNS", "East", 1),
                    ("P-101", ""): ("Hart's tongue, evergreen", {"pot": "ask"}, "FERNS", "East", 1), ("P-200", ""): ("Old rose, 40 petals", {"tray": "90"}, "ROSES RAMBLING", "West", 2)}
    assert [(r["code"], r["description"]) for r in empty.collect()] == [("P-102", "Sold out this year")]
    assert [r["text"] for r in left.collect()] == ["closed on Sundays"]


def test_code_list(spark):
    rows = page(1, [(10, "before any code")], [(10, "P-7"), (40, "Moss")], [(40, "of the woods")], [(10, "a remark")], [(40, "about nothing")], [(10, "P-8"), (40, "Lichen")])
    got, left = E.code_list(spark.createDataFrame(rows, SCHEMA), E.Layout(record=r"(P-\d)(?=\s)", record_max_x=20))
    assert {(r["code"], r["description"]) for r in got.collect()} == {("P-7", "Moss of the woods"), ("P-8", "Lichen")}
    assert [r["text"] for r in left.orderBy("line_no").collect()] == ["before any code", "a remark", "about nothing"]


@pytest.mark.parametrize("text,want", [("Graft 4.5 MSU", ("Graft", "4.5", None, None, None, None)), ("Graft 4 MSU 6+T", ("Graft", "4", None, "6", None, "4 MSU 6+T")), ("Kit $1,250 $30 each", ("Kit", None, "1250", None, None, "$1,250 $30 each")),
                                       ("Pruning 3 3.5", ("Pruning", "3.5", None, None, "3", None)), ("Nothing here", None)])
def test_bulletin_value(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(E.bulletin_value(E.F.col("t")).alias("v")).first()["v"]
    assert (tuple(got) if got else None) == want


BULLETIN = E.Bulletin(record=r"(P-\d+)(?=\s|$)", issued=r"^Leaf no\. \d+, (.+)$", announcement=r"PRICES|WITHDRAWN|NEW", effective=r"[Ff]rom (\w+ \d+, \d{4})", code_in_text=r"P-\d+")


def test_bulletins(spark):
    rows = page(1, [(10, "Leaf no. 4, March 3, 2031")], [(10, "NEW PRICES")], [(10, "From April 1, 2031 these hold:")], [(10, "P-1"), (40, "Trellis ... 12 MSU")], [(10, "P-2"), (40, "Cane, long")], [(42, "and short $8")], [(10, "Note sold by the bundle")],
                [(10, "P-9"), (40, "price to follow")]) + page(2, [(10, "PRICES REVISED")], [(10, "P-3"), (40, "Twine 2 3")], [(10, "THE FOLLOWING ARE WITHDRAWN")], [(10, "P-4 is discontinued from May 2, 2031")])
    rows += page(3, [(10, "PRICES AGAIN")], [(10, "P-6 was discontinued and replaced, from June 1, 2031")], [(10, "P-5"), (40, "Peat 7 MSU")])
    rows[10] = (*rows[10][:4], [(10.0, 20.0, "Now"), *rows[10][4]])
    rows = [r if r[4][0][2] != "P-6" else (*r[:4], [(4.0, 8.0, "As"), *r[4]]) for r in rows]
    got, left = E.bulletins(spark.createDataFrame(rows, SCHEMA), BULLETIN, X.printed_date)
    by = {r["code"]: r for r in got.collect()}
    d = dt.date
    assert (by["P-1"]["action"], by["P-1"]["units"], by["P-1"]["effective_start"], by["P-1"]["description"]) == ("new", "12", d(2031, 4, 1), "Trellis")
    assert (by["P-2"]["description"], by["P-2"]["amount"]) == ("Cane, long and short", "8") and by["P-3"]["old_units"] == "2"
    assert (by["P-3"]["action"], by["P-3"]["effective_start"]) == ("updated", d(2031, 3, 3)) and by["P-5"]["action"] == "updated"
    assert [r["text"] for r in left.collect()] == ["P-9 price to follow"]


def test_profile():
    payer, layout = E.profile('payer = "N"\nrecord = "(P-.+)"\nskip = ["^x$"]\n[columns]\npot = [300, 349]\n')
    assert (payer, layout.columns, layout.skip) == ("N", {"pot": (300.0, 349.0)}, ("^x$",))
    assert isinstance(E.profile('payer = "N"\nkind = "bulletins"\nrecord = "a"\nissued = "b"\nannouncement = "c"\neffective = "d"\ncode_in_text = "e"')[1], E.Bulletin)
    for bad in ('payer = "N"\nkind = "x"\nrecord = "a"', 'payer = "N"\nrecord = "a"\ncolour = 1', 'payer = "N"\nrecord = "a"\n[columns]\npot = [3]'):
        with pytest.raises(ValueError):
            E.profile(bad)


def test_sinks(spark, tmp_path):
    got, _, left = E.records(spark.createDataFrame(PRICES, SCHEMA), NURSERY)
    sinks.write_csv(got.select("description", "page", "code"), str(tmp_path / "csv"), ["code", "description"])
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["code", "description", "page"] and back.count() == 4
    text = sinks.report(got, left, spark.createDataFrame([("P-100",)], "code string"))
    assert "Rows: 4" in text and "Codes: 3" in text and "- 1: 3" in text and "- P-200" in text and "closed on Sundays" in text


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [x.count() for x in E.records(none, NURSERY)] == [0, 0, 0] and [x.count() for x in E.code_list(none, NURSERY)] == [0, 0] and [x.count() for x in E.bulletins(none, BULLETIN, X.printed_date)] == [0, 0]


def test_words_fall_into_lines(spark):
    """A line begins below the reach of the first word of the line before, not of its last."""
    words = [("l", 1, y, x, x + 3, t) for y, x, t in ((20.0, 9.0, "q"), (22.9, 4.0, "p"), (23.5, 1.0, "r"), (40.0, 2.0, "s"))] + [("l", 3, 5.0, 1.0, 2.0, "t"), ("l", 3, 5.0, 1.0, 2.0, "t")]
    out = E.words_to_lines(spark.createDataFrame(words, "doc_id string, page int, top double, x0 double, x1 double, text string")).orderBy("line_no").collect()
    assert ["".join(w["text"] for w in r["words"]) for r in out] == ["pq", "r", "s", "tt"]
