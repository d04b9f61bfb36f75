import random

from termloom.llm import truncation as T

ROWS, COPIES = "tbl string, row_id bigint, source string, text string, word int", "tbl string, text string"


def whole():
    sites, kinds = ["knee", "wrist", "shoulder", "lumbar-spine", "eardrum"], ["Fracture", "Sprain", "Inflammation", "Numbness"]
    tails = ["with routine healing", "observed during hospital admission", "in hospital", "requiring prolonged monitoring", "with fever and chills"]
    random.seed(4)
    out = [f"{k} of {s}{j}{t}" for k in kinds for s in sites for t in tails for j in (", ", " ", "; ")]
    return out + [f"{x}{random.choice([', ', '; '])}{random.choice(tails)}" for x in out] + [f"{k} of {s}" for k in kinds for s in sites]


def cut_rows(spark, texts, copies=()):
    rows = [("w", i, "full", t, 0) for i, t in enumerate(whole())] + [("t", i, "s", t, 0) for i, t in enumerate(texts)]
    got = T.found(spark.createDataFrame(rows, ROWS), spark.createDataFrame([("c", t) for t in copies], COPIES))
    return {(r["tbl"], r["row_id"]) for r in got.collect()}


def test_cut_and_whole(spark):
    cut = ["Fracture of knee, with rou", "Sprain of wrist observed during hospital", "Numbness of shoulder, with fever and", "Sprain of ear", "Fracture of knee, requiring prolonged monitor", "Fracture of knee, with fever an…", "Sprain of wrist requ...",
           "Inflammation of lumbar-spine,", "Fracture of"]
    fine = ["Fracture of knee", "Sprain of wrist, in hospital", "Numbness of shoulder (R)", "Sprain of wrist bilat.", "Fracture of knee, with routine healing", "FOK", None, "", "  ", "...", "Sprain of wirst"]
    got = cut_rows(spark, cut + fine)
    assert got == {("t", i) for i in range(len(cut))}


def test_repeated_rows_and_rates(spark):
    rows = [("w", i, "full", t, 0) for i, t in enumerate(whole())] + [("t", i, None, "Fracture of knee, with rou", 0) for i in range(30)] + [("t", 99, "s", None, 0)]
    df = spark.createDataFrame(rows, ROWS)
    f = T.found(df, spark.createDataFrame([], COPIES))
    assert f.count() == 30
    got = {(r["tbl"], r["source"], r["n_cut"], r["cut_share"]) for r in T.rates(f, df).collect()}
    assert ("t", "none", 30, 1.0) in got and ("w", "full", 0, 0.0) in got


def test_empty(spark):
    assert T.found(spark.createDataFrame([], ROWS), spark.createDataFrame([], COPIES)).count() == 0
