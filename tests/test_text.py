import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import text as X


def plain(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return re.sub("[^a-z0-9]+", " ", re.sub("['’]", "", t)).strip()


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_normalize(spark):
    texts = ["Ménière's", "  --  ", "½ ﬁbre", "İ K Å", "ｆｕｌｌ", "", None, "x" * 100_000] + [f"a{chr(c)}b" for c in [*range(32, 0x2600), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D500)]]
    assert column(spark, texts, X.normalize) == [None if t is None else plain(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=40, max_size=40))
def test_normalize_any(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)]
    assert column(spark, texts, X.normalize) == [plain(t) for t in texts]


@pytest.mark.parametrize("term,key,unspecified", [("Myocardial infarction (acute) NOS", ["infarction", "myocardial"], True), ("Fractures of the wrist, without mention of injury", ["fracture", "wrist"], False),
                                                  ("Ear", None, False), ("of the", None, False), ("Haemorrhage; other than brain, left", ["hemorrhage", "left"], False), ("Diarrhoea", ["diarrhea"], False)])
def test_word_set(spark, term, key, unspecified):
    r = column(spark, [term], X.word_set)[0]
    assert (r["key"], r["unspecified"]) == (key, unspecified)


def test_small_functions(spark):
    assert column(spark, ["heart attacks", "allergies", "bus", "glass", "ties", "arthritis"], X.singular) == ["heart attack", "allergy", "bus", "glass", "tie", "arthritis"]
    assert column(spark, ["Attack, attacks", "Infarct, infarction", "Pain, belly", "Ache"], X.first_variant) == ["Attack", "Infarct", "Pain, belly", "Ache"]
    assert [str(d) for d in column(spark, ["March 3rd, 2021", "3 Mar 2021", "2021-02-30", "Foo 3 2021", "2020-01-05", None], X.printed_date)] == ["2021-03-03", "2021-03-03", "None", "None", "2020-01-05", "None"]
    got = column(spark, ["62+MU", "$45.00", "35%", "Time Only", "1,200"], lambda c: X.printed_fee(c, F.lit("units")))
    assert [(r["number"] and float(r["number"]), r["note"], r["kind"]) for r in got] == [(62, "+MU", "units"), (45, None, "amount"), (None, "35%", None), (None, "Time Only", None), (1200, None, "units")]
