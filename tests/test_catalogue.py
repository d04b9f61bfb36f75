"""Registered queries over small tables written for the purpose."""

import pytest

from termloom.plans import catalogue as Q

CONCEPT = "concept_id bigint, vocabulary_id string, code string, name string, domain string, concept_class string, is_billable boolean, valid_end date"
SYNONYM = "concept_id bigint, term string, term_type string, source string"
EDGE = "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, confidence double, source string"
CONCEPTS = [(1, "UMLS", "C1", "Fever", "symptom", None, None, None), (2, "UMLS", "C2", "Bladder infection", "condition", None, None, None), (3, "LAY", "L3", "Heart attack", "condition", None, None, None),
            (12, "ICD10CM", "R50", "Fever", "symptom", "code", True, None), (13, "ICD10CM", "N39", "Infection of bladder, acute", "condition", "code", True, None), (14, "ICD10CM", "N38", "Infection of bladder, chronic", "condition", "code", True, None),
            (16, "ICD9CM", "410", "Heart attack", "condition", "code", True, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(CONCEPTS, CONCEPT).write.parquet(f"{d}/concept.parquet")
    spark.createDataFrame([(c[0], c[3], "lay" if c[1] == "LAY" else "preferred", c[1]) for c in CONCEPTS], SYNONYM).write.parquet(f"{d}/concept_synonym.parquet")
    spark.createDataFrame([], EDGE).write.parquet(f"{d}/concept_relationship.parquet")
    return d


def test_links_to_codes_of_even_and_odd_ids(spark, tables):
    got = {(r["cui"], r["code_id"]): r["how"] for r in Q.q_link(spark, tables).collect()}
    assert got == {(1, 12): "name", (3, 16): "name", (2, 13): "contained", (2, 14): "contained"}
    assert {(r["cui"], r["code_id"]) for r in Q.q_contained_links(spark, tables).collect()} == {(3, 16), (2, 13), (2, 14)}
