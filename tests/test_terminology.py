"""Linking, lookups, annotation and lexicon on small fixtures."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import annotate as A
from termloom.operators import lexicon as L
from termloom.operators import linking as K
from termloom.operators import lookup

CONCEPT = "concept_id bigint, vocabulary_id string, code string, name string, domain string, concept_class string, is_billable boolean, valid_end date"
SYNONYM = "concept_id bigint, term string, term_type string, source string"
EDGE = "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, confidence double, source string"
U, I, N9, P = "UMLS", "ICD10CM", "ICD9CM", "NS_MSI"
CONCEPTS = [(1, U, "C1", "Heart attack", "condition", None, None, None), (2, U, "C2", "Fracture of wrist", "condition", None, None, None), (3, U, "C3", "Infective cystitis", "condition", None, None, None),
            (4, U, "C4", "Bladder infection", "condition", None, None, None), (5, U, "C5", "Wrist repair", "procedure", None, None, None), (6, U, "C6", "Fever", "symptom", None, None, None),
            (11, I, "I21.9", "Acute myocardial infarction, unspecified", "condition", "code", True, None), (12, I, "S62", "Wrist fracture NOS", "condition", "category", False, None),
            (13, I, "N30", "Cystitis", "condition", "category", True, None), (14, I, "O23", "Infection of bladder in pregnancy", "condition", "code", True, None), (15, I, "N39", "Infection of bladder, acute", "condition", "code", True, None),
            (16, I, "R50", "Fever", "symptom", "code", True, None), (21, N9, "410", "Heart infarct", "condition", "code", True, None), (31, P, "P1", "Repair of wrist", "procedure", "code", True, None)]
SYN = [(1, "Heart attack", "preferred", "UMLS/MTH"), (2, "Fracture of wrist", "preferred", "UMLS/MTH"), (2, "broken wrist", "lay", "UMLS/CHV"), (3, "Infective cystitis", "preferred", "UMLS/MTH"), (4, "Bladder infection", "preferred", "UMLS/MTH"),
       (5, "Wrist repair", "preferred", "UMLS/MTH"), (6, "Fever", "preferred", "UMLS/MTH"), (6, "FV", "abbreviation", "UMLS/MTH"), (11, "Heart attack", "index", "ICD10CM"), (11, "Acute myocardial infarction, unspecified", "preferred", "ICD10CM"),
       (12, "Wrist fracture NOS", "preferred", "ICD10CM"), (13, "Cystitis", "preferred", "ICD10CM"), (14, "Infection of bladder in pregnancy", "preferred", "ICD10CM"), (15, "Infection of bladder, acute", "preferred", "ICD10CM"),
       (16, "Fever", "preferred", "ICD10CM"), (31, "Repair of wrist", "preferred", "NS_MSI"), (21, "Heart infarct", "preferred", "ICD9CM"), (1, None, "lay", None)]
EDGES = [(11, 21, "mapped_from", None, "CMS_GEM"), (1, 11, "maps_to_approx", 0.8, "MATCH/name"), (2, 12, "maps_to_approx", 0.9, "MATCH/words"), (6, 16, "maps_to", None, "X"), (1, 21, "may_be", 0.3, "X")]


@pytest.fixture(scope="module")
def world(spark):
    return spark.createDataFrame(CONCEPTS, CONCEPT).cache(), spark.createDataFrame(SYN, SYNONYM).cache(), spark.createDataFrame(EDGES, EDGE).cache()


def test_link(world):
    c, s, e = world
    got = {(r["cui"], r["code_id"]): (r["score"], r["how"]) for r in K.link(K.Names(c, s), e).collect()}
    assert got[(1, 11)] == (0.8, "name") and got[(1, 21)] == (0.64, "gem")
    assert got[(2, 12)] == (0.95, "words")
    assert got[(3, 13)] == (0.55, "broader")
    assert got[(4, 15)] == (0.54, "contained") and (4, 14) not in got
    assert got[(5, 31)] == (0.85, "words") and got[(6, 16)] == (1.0, "name")
    assert set(got) == {(1, 11), (1, 21), (2, 12), (3, 13), (4, 15), (5, 31), (6, 16)}


def test_direct_links_are_kept(spark, world):
    c, s, e = world
    direct = e.unionByName(spark.createDataFrame([(1, 11, "umls_cui_of", None, "UMLS"), (4, 14, "umls_cui_of", None, "UMLS")], EDGE))
    got = {(r["cui"], r["code_id"]) for r in K.link(K.Names(c, s), direct).collect()}
    assert (1, 11) not in got and (4, 14) not in got and (1, 21) in got
    assert {(r["cui"], r["confidence"]) for r in K.certain_links(K.Names(c, s), direct).collect()} == {(1, None), (4, 0.5)}


def test_rollup(spark):
    nodes = [("I", "block", "block"), ("A", "cat", "category"), ("A1", "x", "code"), ("A2", "open fracture", "code"), ("A3", "x sequela", "code"), ("B", "cat b", "category"), ("B1", "thing, unspecified", "code"), ("B2", "other", "code")]
    par = [("A", "I"), ("A1", "A"), ("A2", "A"), ("A3", "A"), ("B", "I"), ("B1", "B"), ("B2", "B")]
    own = [("A1", "t1"), ("A2", "t2"), ("A3", "t3"), ("B1", "t9")]
    got = K.rollup(spark.createDataFrame(nodes, "node string, title string, concept_class string"), spark.createDataFrame(par, "node string, parent string"), spark.createDataFrame(own, "node string, target string"))
    assert {tuple(r) for r in got.collect()} == {("A", "t1", 0.583), ("A", "t2", 0.467), ("B", "t9", 0.7), ("B2", "t9", 0.6)}


def test_find(spark, world):
    c, s, e = world
    q = spark.createDataFrame([("Heart ATTACK",), ("wrist",), ("broken wrist",), ("zzz",), ("",), (None,)], "query string")
    terms = lookup.find_terms(q, s, c)
    assert {(r["query"], r["code"], r["exact"]) for r in terms.collect()} == {("Heart ATTACK", "C1", True), ("Heart ATTACK", "I21.9", True), ("wrist", "S62", False), ("wrist", "C5", False), ("broken wrist", "C2", True)}
    codes = lookup.find_codes(q, s, c, e, I)
    assert [(r["rank"], r["code"]) for r in codes.filter("query = 'Heart ATTACK'").collect()] == [(1, "I21.9")]
    curated = spark.createDataFrame([("broken wrist", "X9", "picked", 0)], "query string, code string, name string, position int")
    assert [r["code"] for r in lookup.find_codes(q, s, c, e, I, curated=curated).filter("query = 'broken wrist'").orderBy("rank").collect()] == ["X9", "S62"]
    want = spark.createDataFrame([("Heart ATTACK", "I21|I22"), ("broken wrist", "Q"), ("zzz", "*"), ("wrist", "")], "query string, expected string")
    assert tuple(lookup.hit_rate(codes, want).first()) == (3, 2, 1)
    assert {(r["concept_id"], r["code"]) for r in lookup.concept_codes(c, e, [I, N9]).filter("concept_id in (1, 11)").collect()} == {(1, "I21.9"), (11, "I21.9"), (11, "410")}


@pytest.fixture(scope="module")
def terms(world):
    c, s, e = world
    linked = e.select(F.col("concept_id_1").alias("concept_id")).unionByName(c.filter("vocabulary_id <> 'UMLS'").select("concept_id"))
    return A.dictionary(c, s, linked).cache()


TEXTS = {
    1: "Denies fever, but had a heart attack in 2019.", 2: "Her mother had a heart attack; she has fever.", 3: "Possible fracture of the wrist. If fever, call.", 4: "No history of HEART attacks.", 5: "fv and FV", 6: "Heart. Attack", 7: None, 8: "",
    9: "Fever was ruled out.", 10: "é fever",
}


def test_mentions_and_context(spark, terms):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    m = A.with_context(A.mentions(docs, terms), docs)
    got = {(r["doc_id"], r["text"], r["assertion"], r["experiencer"], r["temporality"]) for r in m.collect()}
    assert got == {(1, "fever", "negated", None, None), (1, "heart attack", None, None, "history"), (2, "heart attack", None, "family", None), (2, "fever", None, None, None), (3, "fracture of the wrist", "uncertain", None, None),
                   (3, "fever", "hypothetical", None, None), (4, "HEART attacks", "negated", None, "history"), (5, "FV", None, None, None), (9, "Fever", "negated", None, None), (10, "fever", None, None, None)}
    at = {(r["doc_id"], r["start"], r["end"]) for r in m.filter("doc_id in (5, 10)").collect()}
    assert at == {(5, 7, 9), (10, 2, 7)}


def test_leftmost_longest(spark):
    spans = [(1, 0, 2, "a"), (1, 1, 5, "b"), (1, 2, 1, "c"), (1, 3, 3, "d"), (1, 4, 1, "e"), (2, 9, 1, "f")]
    got = A.leftmost_longest(spark.createDataFrame(spans, "doc_id bigint, i int, n int, key string"))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 2, "a"), (1, 2, 1, "c"), (1, 3, 3, "d"), (2, 9, 1, "f")}


def test_conjunctions(spark, terms):
    docs = spark.createDataFrame([(1, "fever and heart attack"), (2, "wrist fracture and cystitis")], "doc_id bigint, text string")
    both = terms.unionByName(terms.filter("key = 'fever'").limit(1).withColumn("key", F.lit("fever and heart attack")))
    assert {(r["doc_id"], r["text"]) for r in A.mentions(docs, both).collect()} == {(1, "fever"), (1, "heart attack"), (2, "cystitis")}


def test_vote(spark):
    cand = "array<struct<r:int,concept_id:bigint,score:double,term:string,term_type:string>>"
    c = lambda *xs: [(k + 1, i, sc, "t", "lay") for k, (i, sc) in enumerate(xs)]
    rows = [(1, 0, c((1, 1.0), (2, 0.95))), (1, 3, c((3, 1.0))), (1, 5, c((2, 0.9), (9, 0.1))), (2, 0, c((1, 1.0), (2, 0.95))), (3, 0, c((1, 1.0), (2, 0.8))), (4, 0, c((1, 1.0), (2, 0.95))), (4, 2, c((4, 1.0), (5, 0.95))), (4, 4, c((2, 1.0), (6, 0.1)))]
    kinds = [(1, "9", "a"), (2, "10", "b"), (3, "10", "c"), (4, "5", "d"), (5, "10", "e"), (6, "6", "f")]
    got = A.vote(spark.createDataFrame(rows, f"doc_id bigint, i int, candidates {cand}"), spark.createDataFrame(kinds, "concept_id bigint, chapter string, word_key string"))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 2, False), (1, 3, 3, False), (1, 5, 2, False), (2, 0, 1, True), (3, 0, 1, False), (4, 0, 2, False), (4, 2, 5, False), (4, 4, 2, False)}
    codes = spark.createDataFrame([("D12", "x"), ("D70", "x"), ("H10", "x"), ("H61.2", "x"), ("I21.9", "x"), (None, "procedure"), (None, "x")], "c string, d string")
    assert [r[0] for r in codes.select(A.chapter(F.col("c"), F.col("d"))).collect()] == ["2", "3", "7", "8", "9", "procedure", None]


def test_context_codes(spark):
    found = [(1, 0, None, "family", "history", "breast cancer", "C50.9"), (1, 2, "negated", "family", None, "breast cancer", None), (1, 4, None, None, "history", "asthma", None), (1, 6, None, None, None, "asthma", None),
             (1, 8, None, None, "history", "x y z", None), (1, 10, None, None, "history", "breast cancer", "C50.9"), (1, 12, None, None, "history", "gout", None)]
    titles = [("family", "ICD10CM", "breast cancer", "Z80.3"), ("family", "ICD10CM", "cancer", "Z80"), ("history", "ICD10CM", "asthma bronchial", "Z87"), ("history", "ICD10CM", "x", "Q"), ("history", "ICD10CM", "chronic gout severe", "Z88")]
    curated = [("history", "C5", "ICD10CM", "Z85.0"), ("history", "C50", "ICD10CM", "Z85.3"), ("history", "C50", "ICD9CM", "V10.3")]
    f = spark.createDataFrame(found, "doc_id bigint, i int, assertion string, experiencer string, temporality string, word_key string, code string")
    got = A.context_codes(f, spark.createDataFrame(titles, "kind string, vocabulary_id string, word_key string, code string"), spark.createDataFrame(curated, "kind string, prefix string, vocabulary_id string, code string"))
    assert {(r["i"], r["code"], r["confidence"]) for r in got.collect()} == {(0, "Z80.3", 1.0), (0, "V19.8", 0.5), (4, "Z87", 0.8), (10, "Z85.3", 1.0), (10, "V10.3", 1.0), (12, "Z88", 0.7)}
    c = spark.createDataFrame([("ICD10CM", "Z80.3", "Family history of malignant neoplasm of breast", None), ("ICD10CM", "Z87", "Personal history of asthma, not elsewhere classified", None), ("ICD10CM", "X", "Old age", None), ("UMLS", "Y", "Family history of asthma", None)],
                              "vocabulary_id string, code string, name string, valid_end date")
    assert {(r["kind"], r["code"], r["word_key"]) for r in A.history_titles(c).collect()} == {("family", "Z80.3", "breast malignant neoplasm"), ("history", "Z87", "asthma")}


def test_lexicon_in_annotation(spark, terms, world):
    c, s, e = world
    codes = lookup.concept_codes(c, e, [I, N9])
    pats = spark.createDataFrame([(1, "bad <part>"), (2, "broken heart"), (3, "hot and bothered"), (4, "heart attack"), (5, "odd feeling")], "pattern_id bigint, pattern string")
    targets = spark.createDataFrame([(1, 1, "{adj} thing"), (1, 2, "fracture of {part}+icd9cm:410"), (2, 1, "-"), (3, 1, "icd10cm:I21.9"), (3, 2, "fever"), (4, 1, "nothing known"), (5, 1, "fever")], "pattern_id bigint, item_pos int, item string")
    parts = spark.createDataFrame([("wrist", "the wrist", None, None)], L.PART)
    docs = spark.createDataFrame([(1, "A bad wrist, a broken heart attack, hot and bothered. Heart attack! odd feeling")], "doc_id bigint, text string")
    lex = L.compiled(pats)
    ev = A.spotted(docs, terms, lex, parts, cues=True)
    m = A.mentions(docs, terms, L.options(L.found(ev, lex), targets, parts, terms, c, codes), ev).cache()
    got = {r["text"]: [x["concept_id"] for x in r["candidates"]] for r in m.collect()}
    assert set(got) == {"bad wrist", "hot and bothered", "Heart attack", "odd feeling"} and len(got["hot and bothered"]) == 2
    coded = {r["text"]: [(x["vocabulary_id"], x["code"]) for x in r["codes"]] for r in A.with_codes(m, codes).collect()}
    assert coded["bad wrist"][0] == ("ICD9CM", "410") or ("ICD9CM", "410") in coded["bad wrist"]
    assert {tuple(r) for r in L.unresolved(targets, parts, terms, c).collect()} == {(4, 1, "nothing known")}


def test_judge(spark):
    m = spark.createDataFrame([(1, 0, "Left wrist", None, None, None), (1, 5, "fever", "negated", None, "history"), (2, 0, "fever", None, "family", None)], "doc_id bigint, i int, text string, assertion string, experiencer string, temporality string")
    codes = spark.createDataFrame([(1, 0, "S62"), (1, 5, "R50"), (2, 0, "R50")], "doc_id bigint, i int, code string")
    item = "item_id bigint, item_pos int, item string"
    expect = spark.createDataFrame([(1, 1, "wrist=S6|X"), (1, 2, "-fever"), (1, 3, "wrist=Q"), (2, 1, "fever[family]=*"), (2, 2, "fever=*"), (3, 1, "gone")], item)
    forbid = spark.createDataFrame([(1, 1, "left"), (1, 2, "wri"), (2, 1, "FEVER")], item)
    got = {(r["kind"], r["item_id"], r["item_pos"]) for r in A.judge(m, codes, expect, forbid).collect() if r["hit"]}
    assert got == {("expected", 1, 1), ("expected", 1, 2), ("expected", 2, 1), ("forbidden", 1, 1), ("forbidden", 2, 1)}


def test_senses(spark):
    docs = spark.createDataFrame([(1, "pt with MS and leg weakness, night sweats"), (2, "MS heart"), (3, "MS")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, 2, 1, "MS"), (2, 0, 1, "MS"), (3, 0, 1, "MS")], "doc_id bigint, i int, n int, text string")
    senses = spark.createDataFrame([("ms", "sclerosis", "leg weakness"), ("ms", "sclerosis", "night sweats"), ("ms", "stenosis", "heart"), ("ms", "stenosis", "leg"), ("ms", "stenosis", "ms"), (None, "x", "y")], "term string, target string, cue string")
    got = {tuple(r) for r in A.sense_hits(found, docs, senses).collect()}
    assert got == {(1, 2, "sclerosis", 2, True), (1, 2, "stenosis", 1, False), (2, 0, "stenosis", 1, True)}


def test_lexicon(spark):
    assert set(L.expand("[cant|unable to] walk")) == {("cant", "walk"), ("unable", "to", "walk")}
    assert set(L.expand("[sore|bad] <part> [since [a|b]]?")) == {(x, "<part>", *t) for x in ("sore", "bad") for t in ((), ("since", "a"), ("since", "b"))}
    assert set(L.expand("my? knee")) == {("my", "knee"), ("knee",)} and L.expand("") == []
    pats = spark.createDataFrame([(1, "[sore|bad] <part>"), (2, "sore <part> since work"), (3, "hurt <det> <part>"), (4, None), (5, "[sore|bad] <part>")], "pattern_id bigint, pattern string")
    docs = spark.createDataFrame([(1, "A sore left wrist; sore wrist since work."), (2, "hurt my left upper arm. Sore, wrist"), (3, None)], "doc_id bigint, text string")
    want = {(1, 4, 4, 2, "wrist"), (2, 0, 5, 3, "upper arm")}
    assert {tuple(r) for r in L.matches(docs, pats, ["wrist", "upper arm"]).collect()} == want
    upper = spark.createDataFrame([(1, "cp", "upper"), (2, "sob", None)], "pattern_id bigint, pattern string, case string")
    docs = spark.createDataFrame([(1, "CP and cp, SOB, sob")], "doc_id bigint, text string")
    assert {(r["i"], r["pattern_id"]) for r in L.matches(docs, upper, []).collect()} == {(0, 1), (3, 2), (4, 2)}
    assert L.filled("pain in {part}", "wrist") == "pain in wrist" and L.filled("{adj} pain", None) is None


def test_stream(spark, terms, tmp_path):
    from termloom.streaming.annotate_stream import annotate_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Denies fever."), (2, "heart attack")], "doc_id bigint, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(src)
    annotate_stream(stream, terms, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {(r["doc_id"], r["assertion"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "negated"), (2, None)}
