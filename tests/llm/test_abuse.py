from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.llm import abuse as A


@pytest.fixture(scope="module")
def model():
    return A.train(pd.DataFrame({"text": ["The clinic opens at nine. Please bring your card."] * 3, "label": ["none"] * 3}))


def doc(model, text):
    ss = A.parts(text)
    return float(A.score(*A.featurize(ss), model).max()) if ss else 0.0


@pytest.mark.parametrize("text", ["You are a stupid idiot", "Caller: hello there.\nY0u are a f1lthy looooser.", "i will smash your face in", "Send me n u d e pics, are you horny?", "Foreigners are vermin, send them back", "TU ES UNE ORDURE, VA CREVER.!!"])
def test_harsh(model, text):
    assert doc(model, text) >= A.THRESHOLD


@pytest.mark.parametrize("text", ["Reports a neighbour called her an idiot, feels unsafe at home.", "My knee has been killing me.", "Breast exam normal, chaperone present.", "Stupid me, i took insulin twice on monday", "This stupid printer is broken again", "", "...", "4 5 6"])
def test_mild(model, text):
    assert doc(model, text) < A.THRESHOLD


def test_pairs_count():
    """Two terms that are harmless alone and harmful together are learnt from their interaction."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        noise = [int(x) for x in rng.integers(1000, 1030, 3)]
        rows.append(np.array(sorted({11 if a else 12, 21 if b else 22, *noise})))
        y.append(float(a == b))
    m = A.fit(rows, np.array(y), np.ones(len(y)), epochs=30)
    p = A.score_rows([np.array(r) for r in ([11, 21], [11, 22], [12, 21], [12, 22])], m)
    assert p[0] > 0.8 and p[3] > 0.8 and p[1] < 0.2 and p[2] < 0.2


@pytest.mark.parametrize("d,least", [("sf0.1", 0.55), ("check_l", 0.8)])
def test_held_out_labels(spark, d, least):
    """Fitted on the labels of half of the sources, judged by the labels of the others, a few of which are wrong. sf0.1 has
    only some thirty positive labels to learn from."""
    if not Path(f"/root/testdata/{d}").exists():
        pytest.skip("no such tables")
    read = lambda t: spark.read.parquet(f"/root/testdata/{d}/{t}.parquet")
    docs, half = read("documents"), F.coalesce("source", F.lit("")).isin("clinic_notes", "patient_forum", "fee_guides", "chat_import")
    model = A.train(A.labelled_rows(docs.filter(half), read("review_label")))
    held = docs.filter(~half).join(read("review_label"), "doc_id")
    got = A.scores(held.select("doc_id", "source", "text"), model).join(held.select("doc_id", "label"), "doc_id").toPandas()
    bad, hit = got["label"] != "none", got["score"] >= A.THRESHOLD
    print("held out", d, (hit & bad).sum(), hit.sum(), bad.sum())
    assert (hit & bad).sum() >= 0.9 * hit.sum() and (hit & bad).sum() >= least * bad.sum()


def test_lines_broken_inside_a_sentence(model):
    assert doc(model, "you \nare \na \nstupid \nidiot") >= A.THRESHOLD and A.parts("one\ntwo \n> three") == ["one", "two three"]


def test_scores(spark, model):
    rows = [(1, "s", None, 0), (2, None, "", 0), (3, "s", "hello. " * 20_000 + "you stupid pig", 0), (3, "s", "fine", 0)]
    got = A.scores(spark.createDataFrame(rows, "doc_id bigint, source string, text string, score int"), model)
    assert sorted((r["doc_id"], r["score"] >= 0.5) for r in got.collect()) == [(1, False), (2, False), (3, False), (3, True)]
    assert {(r["source"], r["n_docs"], r["n_found"]) for r in A.rates(got).collect()} == {("s", 3, 1), ("none", 1, 0)}
    assert A.scores(spark.createDataFrame([], "doc_id bigint, source string, text string"), model).count() == 0
    assert len(A.labelled_rows(spark.createDataFrame(rows[:3], "doc_id bigint, source string, text string, score int"), spark.createDataFrame([(3, "abuse", "x"), (3, "none", None), (9, "hate", ""), (None, None, None)], "doc_id bigint, label string, text string"))) == 2
