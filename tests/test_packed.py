import pytest
from hypothesis import given
from hypothesis import strategies as st

from termloom.operators import packed as P
from termloom.plans.problems import RULES

ALL = P.SEPARATORS


@pytest.mark.parametrize("text,items", [
    ("a; b, c|d", ["a", "b", "c", "d"]), ("\"left | right\" / x", ["left | right", "x"]), ("n/v and/or", ["n/v and/or"]), ("n/v / and/or", ["n/v", "and/or"]),
    ("can't sleep, 'worse, at night'", ["can't sleep", "worse, at night"]), ('"5"" scar"; x', ['5" scar', "x"]), ('"""puffy"" neck"', ['"puffy" neck']), ("a||b;;", ["a", "b"]),
    ("''", []), ('"unclosed, b', ['"unclosed', "b"]), ("  x  ", ["x"]), ("icd10cm:A+icd9cm:1\t-", ["icd10cm:A+icd9cm:1", "-"]), ("'it''s, so'", ["it's, so"]), (",", []), ("a,'b'c", ["a", "'b'c"])])
def test_split(text, items):
    assert P.split_items(text, ALL, P.QUOTES[0]) == items


def test_expect_keeps_alternatives_and_brackets():
    text = 'x[family,history]=A|B.1; "y, on and off=C|D"'
    assert P.candidates(text, RULES["expect"])[0][0] == ["x[family,history]=A|B.1", "y, on and off=C|D"]


def test_unwrap():
    assert P.unwrap(' ["a", "b"] ') == '"a", "b"' and P.unwrap("[a] b [c]") == "[a] b [c]" and P.unwrap("(a)") == "a" and P.unwrap("") == ""


@given(st.lists(st.text("ab'\" ,;|/\t\n", min_size=1, max_size=6).filter(lambda t: t.strip() == t), max_size=5))
def test_round_trip(values):
    text = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert P.split_items(text, ALL, P.QUOTES[0]) == values


@given(st.text("ab'\" ,;|/[]\t\n", max_size=30))
def test_never_fails(text):
    for rule in (P.PLAIN, *RULES.values()):
        for items, _ in P.candidates(text, rule):
            assert all(i and i == i.strip() for i in items)


def test_dialect_follows_the_values_of_all_rows(spark):
    rows = [("t", i, "cues", "night sweats", 0) for i in range(40)] + [("t", 100, "cues", "night sweats;rash", 0), ("t", 101, "cues", None, 0), ("t", 102, "cues", " ", 0), ("t", 103, "cues", "rash", 0),
                                                                      ("t", 103, "cues", "rash", 0)]
    got = P.unpack(spark.createDataFrame(rows, "tbl string, row_id bigint, field string, text string, item int"))
    assert {(r["item_pos"], r["item"]) for r in got.filter("row_id = 100").collect()} == {(1, "night sweats"), (2, "rash")}
    assert got.filter("row_id in (101, 102)").count() == 0 and got.filter("row_id = 103").count() == 2


def test_coarser_dialect_of_a_frequent_value(spark):
    """A comma stays inside a value that many fields hold whole, and separates values that occur on their own."""
    texts = ["pain, chronic"] * 39 + ["pain, chronic; arm"] + ["rash, fever", "fever, cough", "cough", "rash; cough", "fever", "rash"] * 3
    for per_salt in (1_000_000, 10):
        got = P.unpack(spark.createDataFrame([("t", i, "f", t) for i, t in enumerate(texts)], "tbl string, row_id bigint, field string, text string"), per_salt=per_salt)
        by = {}
        for r in sorted(got.collect()):
            by.setdefault(r["row_id"], []).append(r["item"])
        assert by[0] == ["pain, chronic"] and by[39] == ["pain, chronic", "arm"] and by[40] == ["rash", "fever"] and by[41] == ["fever", "cough"]


def test_empty(spark):
    assert P.unpack(spark.createDataFrame([], "tbl string, row_id bigint, field string, text string")).count() == 0


def test_long_text():
    assert len(P.split_items(",".join(["abc"] * 50_000), ALL, P.QUOTES[0])) == 50_000
