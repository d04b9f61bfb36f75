import numpy as np
import pytest

from termloom.llm import mixing as M

DOCS, TARGETS = "doc_id bigint, source string, text string, shard int", "source string, target_share double, max_repeats int"


def test_split_tree():
    counts = np.array([100, 7, 0, 33])
    nodes = M.split_tree(counts, 5, 0)
    assert [(f, n) for f, n, _ in nodes] == [(i, 1) for i in range(5)]
    got = np.stack([c for _, _, c in nodes])
    assert got.shape == (5, 4) and (got.sum(axis=0) == counts).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 3


def test_many_shards_keep_the_shares(spark):
    """10,000 shards of some 90,000 documents each: sizes and every source's share within 5 % of the target."""
    want = np.array([0.4, 0.2, 0.2, 0.1, 0.1])
    uses = (want * M.MOST_USES / M.BLOCK_DOCS).astype("int64").tolist()
    got = M.shares_of(spark, uses, 10_000, 1).toPandas()
    t = got.pivot(index="shard", columns="source_no", values="n").to_numpy()
    assert t.shape == (10_000, 5) and t.sum(axis=0).tolist() == uses
    size = t.sum(axis=1)
    assert abs(size / size.mean() - 1).max() < 0.05
    assert abs(t / size[:, None] / want - 1).max() < 0.05
    one = got[got["source_no"] == 3].sort_values("start")
    assert (one["start"].to_numpy()[1:] == (one["start"] + one["n"]).to_numpy()[:-1]).all()


def test_blocks_of_a_range(spark, monkeypatch):
    """The edge is found by ranges of blocks first: with few ranges the shares are as exact."""
    monkeypatch.setattr(M, "SUPER", 4)
    docs = [(i, "a" if i % 3 else "b", "word " * (i % 7 + 1), 0) for i in range(600)]
    _, rep = M.mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], TARGETS))
    by = {r["source"]: r for r in rep.collect()}
    assert abs(by["a"]["actual_share"] - 0.3) < 0.01 and by["b"]["most_repeats"] == 2


def test_mixture(spark):
    docs = [(i, "big", "word " * (i % 9 + 1), 0) for i in range(400)] + [(1000 + i, "small", "other words here", 0) for i in range(40)]
    docs += [(2000, None, "x", 0), (2001, "unknown", "x", 0), (2002, "small", None, 0), (2003, "small", "", 0), (1000, "small", "other words here", 0)]
    t = [("big", 0.6, 1), ("small", 0.4, 3), ("none", None, 2), ("big2", 0.0, 1)]
    mix, rep = M.mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(t, TARGETS), shards=3)
    rows = mix.collect()
    by = {r["source"]: r for r in rep.collect()}
    assert abs(by["big"]["actual_share"] - 0.6) < 0.02 and abs(by["small"]["actual_share"] - 0.4) < 0.02
    assert by["small"]["most_repeats"] == 3 and by["big"]["most_repeats"] <= 1 and by["none"]["tokens_used"] == 0
    assert {r["source"] for r in rows} == {"big", "small"} and {r["shard"] for r in rows} == {0, 1, 2}
    for s in range(3):
        assert sorted(r["position"] for r in rows if r["shard"] == s) == list(range(1, 1 + sum(r["shard"] == s for r in rows)))
    assert sorted((r["doc_id"], r["copy"], r["shard"]) for r in rows) == sorted((r["doc_id"], r["copy"], r["shard"]) for r in M.mixture(spark.createDataFrame(docs[::-1], DOCS), spark.createDataFrame(t, TARGETS), shards=3)[0].collect())


@pytest.mark.parametrize("docs,targets", [([], [("a", 0.5, 1)]), ([(1, "a", "x", 0)], []), ([(1, "a", "x", 0)], [("a", 0.5, 1), ("gone", 0.5, 2)])])
def test_no_mixture(spark, docs, targets):
    mix, rep = M.mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    assert mix.count() == 0 and rep.count() == len(targets)


def test_tokens(spark):
    rows = M.with_tokens(spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "text string")).collect()
    assert [r["n_tokens"] for r in rows][:3] == [2, 0, 0] and rows[3]["n_tokens"] > 1
