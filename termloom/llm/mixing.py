"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a seeded hash, which is a random permutation. The size of the mixture is
the largest at which no source exceeds its cap; a source then gives whole passes over all its documents and, in the
last pass, the first of its permuted blocks, the last of them cut at a document. The block uses of every source are
split among the output shards by a binary tree: at each node the number each half gets of each source is one
multivariate hypergeometric draw, so every shard is a random sample without replacement of the mixture. The top of the
tree is drawn by the driver, its subtrees by tasks. A shard takes consecutive block uses of each source in the order of
an affine permutation; its documents are shuffled within it by hash.

Blocks are small (about a document each), so their number grows with the documents and a shard has many of every source.
No table of blocks is kept: the driver sees the sums of SUPER ranges per source, and the blocks of one range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SUPER = 4096      # ranges of blocks whose sums the driver sees
BLOCK_DOCS = 1    # documents a block has, on average, until one of the next two bounds is reached
MOST_BLOCKS = 1 << 26  # of a source, so that all uses stay within the range of the hypergeometric draw
MOST_USES = 900_000_000
SHARDS = 16       # at least
SHARD_DOCS = 100_000  # documents a shard has, about, beyond that
MOST_SHARDS = 1 << 16  # beyond it shards grow
SUBTREES = 1024   # of the splitting tree that the driver draws; each is split further by a task


def with_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Adds n_tokens; a null or empty text has none."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = _loaded.get(path)
        if t is None:
            t = _loaded[path] = Tokenizer.from_file(path)
            t.encode_special_tokens = True
        out = []
        for lo in range(0, len(texts), 256):
            out += [len(e.ids) for e in t.encode_batch(texts.iloc[lo : lo + 256].fillna("").tolist(), add_special_tokens=False)]
        return pd.Series(out, dtype="int32")

    return docs.withColumn("n_tokens", count("text"))


_loaded: dict = {}


def split_once(counts: np.ndarray, left: int, shards: int, rng: np.random.Generator) -> np.ndarray:
    """What the first ``left`` of ``shards`` get of the counts of each source: one multivariate hypergeometric draw."""
    draw = int(counts.sum()) * left // shards
    # the draw one source at a time: conditional hypergeometrics make up the multivariate one
    got, rest = np.zeros_like(counts), draw
    after = counts[::-1].cumsum()[::-1]
    for k, n in enumerate(counts):
        others = int(after[k] - n)
        got[k] = rng.hypergeometric(int(n), others, rest) if n and rest else 0
        rest -= int(got[k])
    return got


def split_tree(counts: np.ndarray, shards: int, seed: int, first: int = 0, stop: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(first shard, shards, counts of each source) of the nodes with at most ``stop`` shards.

    A node draws from a generator of its own, seeded by its place, so any task can go on from any node."""
    if shards <= stop:
        return [(first, shards, counts)]
    left = shards // 2
    got = split_once(counts, left, shards, np.random.default_rng([seed, first, shards]))
    return split_tree(got, left, seed, first, stop) + split_tree(counts - got, shards - left, seed, first + left, stop)


def shares_of(spark, uses: list[int], shards: int, seed: int) -> DataFrame:
    """source_no, shard, start, n: the block uses each shard owns of each source, numbered from 0 within the source.

    The driver draws the top of the tree down to SUBTREES nodes, the tasks the rest; a node knows where its uses begin,
    as a subtree owns consecutive ones."""
    stop = max(1, -(-shards // SUBTREES))
    top = split_tree(np.array(uses, dtype="int64"), shards, seed, stop=stop)
    begin, rows = np.zeros(len(uses), dtype="int64"), []
    for first, n, counts in top:
        rows.append((first, n, counts.tolist(), begin.tolist()))
        begin = begin + counts

    def run(batches):
        for pdf in batches:
            out = []
            for first, n, counts, at in zip(pdf["first"], pdf["n"], pdf["counts"], pdf["at"]):
                at = np.array(at, dtype="int64")
                for shard, _, got in split_tree(np.array(counts, dtype="int64"), int(n), seed, int(first)):
                    out += [(k, shard, int(a), int(g)) for k, (a, g) in enumerate(zip(at, got))]
                    at = at + got
            yield pd.DataFrame(out, columns=["source_no", "shard", "start", "n"])

    df = spark.createDataFrame(rows, "first int, n int, counts array<bigint>, at array<bigint>")
    return df.mapInPandas(run, "source_no int, shard int, start bigint, n bigint")


def _coprime(n: int, rng: np.random.Generator) -> int:
    """A random factor without a common divisor with n."""
    while True:
        a = int(rng.integers(1, max(2, n)))
        if math.gcd(a, n) == 1:
            return a


def mixture(docs: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 1, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, source, text; targets: source, target_share, max_repeats. Gives (mixture, report).

    mixture: shard, position (random order within the shard), doc_id, source, copy (from 1), n_tokens. report: a row
    per target source with its shares. Shares are taken relative to their sum; a target with a null or non-positive
    share, or max_repeats below 1, takes no part and keeps its row in the report with nothing used. Documents without a
    source or a target, or without a token, take no part. If a source with a share has no token at all, no mixture
    exists and it is empty. Repeated texts are documents of their own. Empty inputs give empty results."""
    spark = docs.sparkSession
    goals = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect()}  # a row per source
    goals = {k: v for k, v in goals.items() if k is not None}
    use = {k: v for k, v in goals.items() if v[0] > 0 and v[1] >= 1}
    d = with_tokens(spread(docs.filter(F.col("source").isin(list(use)) & F.col("text").isNotNull()).select("doc_id", "source", "text")), path)
    d = cut(d.drop("text").filter("n_tokens > 0"))
    sizes = {r["source"]: (r["n"], r["t"]) for r in d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    names = sorted(use)
    share = sum(use[k][0] for k in names)
    total = min((sizes.get(k, (0, 0))[1] * use[k][1] * share / use[k][0] for k in names), default=0)
    names = names if total else []
    shards = shards or min(MOST_SHARDS, max(SHARDS, -(-sum(sizes[k][0] * use[k][1] for k in names) // SHARD_DOCS)))
    # how often every document of a source goes in, and what is left for a last pass over a part of them
    passes, left = {}, {}
    for k in names:
        quota, have = total * use[k][0] / share, sizes[k][1]
        passes[k] = min(use[k][1], int(quota / have + 1e-9))
        left[k] = 0 if passes[k] == use[k][1] else max(0, int(quota - passes[k] * have))
    most = MOST_USES // max(1, sum(p + 1 for p in passes.values()))
    blocks = {k: max(1, min(sizes[k][0] // BLOCK_DOCS, MOST_BLOCKS, most)) for k in names}
    wide = {k: max(1, -(-blocks[k] // SUPER)) for k in names}
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), _mapped("source", blocks, "bigint", 1)))
    ranges = F.floor(F.col("block") / _mapped("source", wide, "bigint", 1)).cast("int")
    edge, room = {k: 0 for k in names}, dict(left)

    # first over the ranges of blocks, then over the blocks of the range in which the edge lies
    sums = d.groupBy("source", ranges.alias("at")).agg(F.sum("n_tokens").alias("t"))
    got = {(r["source"], r["at"]): r["t"] for r in sums.collect()} if names else {}  # at most SUPER per source
    for k in names:
        at = 0
        while at * wide[k] < blocks[k] and got.get((k, at), 0) <= room[k]:
            room[k] -= got.get((k, at), 0)
            at += 1
        edge[k] = at * wide[k]
    if any(wide[k] > 1 for k in names):
        here = d.filter(ranges == F.floor(_mapped("source", edge, "bigint", -1) / _mapped("source", wide, "bigint", 1)).cast("int"))
        fine = {(r["source"], r["block"]): r["t"] for r in here.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).collect()}  # the blocks of one range per source
        for k in names:
            stop = min(blocks[k], edge[k] + wide[k])
            while edge[k] < stop and fine.get((k, edge[k]), 0) <= room[k]:
                room[k] -= fine.get((k, edge[k]), 0)
                edge[k] += 1
    uses = {k: passes[k] * blocks[k] + min(blocks[k], edge[k] + 1) for k in names}
    d = d.withColumn("passes", _mapped("source", passes, "int", 0)).withColumn("edge", _mapped("source", edge, "bigint", -1)).withColumn("room", _mapped("source", room, "bigint", 0))
    # the last block is cut at a document; it has few
    cut_block = d.filter("block = edge").withColumn("run", F.sum("n_tokens").over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")))
    last = d.filter("block <> edge").withColumn("more", (F.col("block") < F.col("edge")).cast("int")).unionByName(cut_block.withColumn("more", (F.col("run") <= F.col("room")).cast("int")).drop("run"))
    copies = last.withColumn("copy", F.explode(F.when(F.col("passes") + F.col("more") > 0, F.sequence(F.lit(1), F.col("passes") + F.col("more"))).otherwise(F.array().cast("array<int>"))))
    # the uses of a source are permuted by an affine map, so a shard's consecutive uses are blocks from everywhere
    rng = np.random.default_rng(seed)
    factor, shift = {k: _coprime(uses[k], rng) for k in names}, {k: int(rng.integers(0, max(1, uses[k]))) for k in names}
    owned = shares_of(spark, [uses[k] for k in names], shards, seed).filter("n > 0") if names else None
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if names:
        pdf = owned.toPandas()  # at most MOST_SHARDS rows per source
        for i, k in enumerate(names):
            one = pdf[pdf["source_no"] == i].sort_values("start")
            held[k] = one["start"].to_numpy(dtype="int64"), one["shard"].to_numpy(dtype="int32")
    shared = spark.sparkContext.broadcast({"held": held, "blocks": blocks, "uses": uses, "factor": factor, "shift": shift})

    @F.pandas_udf("int")
    def shard_of(source: pd.Series, block: pd.Series, copy: pd.Series) -> pd.Series:
        v, out = shared.value, np.zeros(len(source), dtype="int32")
        names_, block, copy = source.to_numpy(), block.to_numpy(dtype="int64"), copy.to_numpy(dtype="int64")
        for k in set(names_):
            m = names_ == k
            start, shard = v["held"][k]
            u = (copy[m] - 1) * v["blocks"][k] + block[m]
            at = (u * v["factor"][k] + v["shift"][k]) % v["uses"][k]  # below 2**60
            out[m] = shard[np.searchsorted(start, at, side="right") - 1]
        return pd.Series(out)

    out = copies.withColumn("shard", shard_of("source", "block", "copy"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy")
    out = cut(out.select("shard", "doc_id", "source", "copy", "n_tokens"))
    used = out.groupBy(F.col("source").alias("s_")).agg(F.sum("n_tokens").alias("u"), F.max("copy").alias("m"), F.count_distinct("doc_id").alias("docs"))
    all_used = F.sum(F.coalesce("u", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # a row per source
    rep = spark.createDataFrame([(k, v[0], v[1], int(sizes.get(k, (0, 0))[0]), int(sizes.get(k, (0, 0))[1])) for k, v in sorted(goals.items())],
                                "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint")
    rep = rep.join(used, F.col("source") == F.col("s_"), "left").withColumn("all_used", all_used)
    rep = rep.select("source", "target_share", F.round(F.coalesce("u", F.lit(0)) / F.greatest("all_used", F.lit(1)), 6).alias("actual_share"), "max_repeats",
                     F.coalesce("m", F.lit(0)).alias("most_repeats"), "n_docs", F.coalesce("docs", F.lit(0)).cast("bigint").alias("docs_used"), "n_tokens", F.coalesce("u", F.lit(0)).cast("bigint").alias("tokens_used"))
    return out.withColumn("position", F.row_number().over(order)).select("shard", "position", "doc_id", "source", "copy", "n_tokens"), rep


def _mapped(col: str, values: dict, kind: str, default: int) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(col) == k, F.lit(int(v))).otherwise(out)
    return out.cast(kind)


__all__ = ["mixture", "shares_of", "split_tree", "with_tokens"]
