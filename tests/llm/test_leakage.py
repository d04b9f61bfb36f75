import random

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import leakage as L
from termloom.llm.fold import fold, words, words_with_places


def brute(docs, items, n):
    at = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in at.get(tuple(w[k : k + n]), ())}


def test_fold():
    assert fold("Ménière's  ｆｏｏ—½") == "menieres foo 1 2" and words(None) == [] and fold("'’") == ""


@given(st.text(max_size=40))
def test_places(text):
    assert [w for w, _, _ in words_with_places(text)] == words(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6), st.lists(st.sampled_from("abcx"), max_size=40), st.integers(1, 4))
def test_automaton(items, doc, n):
    items = list(enumerate(map(list, items)))
    a = L.Automaton(items, n)
    got = {i for _, _, t in a.run(doc) for i in a.holders[t]}
    assert got == {i for _, i in brute([(0, " ".join(doc))], [(i, " ".join(w)) for i, w in items], n)}
    for pos, size, _ in a.run(doc):
        piece = doc[pos - size + 1 : pos + 1]
        assert any(piece == w[k : k + size] for _, w in items for k in range(len(w)))


def test_leaks(spark):
    random.seed(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, None if i % 9 == 0 else " ".join(random.choice(vocab) for _ in range(random.randrange(16)))) for i in range(40)] + [(99, "")]
    docs = []
    for i in range(200):
        t = " ".join(random.choice(vocab) for _ in range(30))
        src = random.choice(items)[1]
        docs.append((i, None if i % 40 == 0 else t + " " + (src or "").upper().replace(" ", ", ") + " " + t, 1))
    d, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (10, 10_000):
        assert {tuple(r) for r in L.leaks(d, it, 5, block).collect()} == brute([x[:2] for x in docs], items, 5)
    assert L.leaks(d.limit(0), it).count() == 0 and L.leaks(d, it.limit(0)).count() == 0


def test_many_blocks_read_the_corpus_once(spark):
    random.seed(6)
    items = [(i, " ".join(f"w{random.randrange(50)}" for _ in range(40))) for i in range(12)] + [(50, " ".join(f"long{k}" for k in range(900)))]
    docs = [(i, f"intro {items[i % 12][1]} outro {i}") for i in range(60)] + [(100, " ".join(f"long{k}" for k in range(140, 170))), (101, " ".join(f"x{k}" for k in range(2000)))]
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    d = spark.createDataFrame(docs, "doc_id bigint, text string").mapInPandas(tell, "doc_id bigint, text string")
    got = {tuple(r) for r in L.leaks(d, spark.createDataFrame(items, "item_id bigint, text string"), 8, 150).collect()}
    assert got == brute(docs, items, 8) and seen.value == len(docs)
    assert got == {(i, i % 12) for i in range(60)} | {(100, 50)}


def test_spans(spark):
    text = "Before all. One two three, four five six seven EIGHT nine! After that there is quite some more text to keep here."
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id bigint, text string")
    rows = [(1, text), (2, "one two three four five six seven eight nine"), (3, "nothing here"), (4, None)]
    got = {r["doc_id"]: r for r in L.spans(spark.createDataFrame(rows, "doc_id bigint, text string"), item).collect()}
    assert set(got) == {1, 2} and got[2]["action"] == "drop" and got[2]["cleaned"] is None
    assert got[1]["cleaned"] == "Before all. ! After that there is quite some more text to keep here." and got[1]["longest"] == 9
