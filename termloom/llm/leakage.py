"""Evaluation texts in training texts, by a generalised suffix automaton of the test items.

The automaton is built over the folded words of the items; a training text is streamed through it, and at each word the
length of the longest match that ends there is known. Where that is at least ``least`` words, every item that holds the
last ``least`` words is a hit; these items are stored with the state.

The training texts are read once whatever the number of items. Items of at most ``block_words`` words in all make one
automaton, which is broadcast. More are cut into blocks, each with an automaton that the task which needs it builds: one
pass over the texts keeps those with a sequence of ``least`` words whose hash is among those of the items (a bit table of
bounded size, which may keep too many texts but loses none), their hashes are joined to the blocks, and only these pairs
of text and block are streamed. Long items are cut into pieces that overlap by ``least`` - 1 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.fold import words, words_with_places
from termloom.session import cut, spread, width

LEAST = 8
BLOCK_WORDS = 100_000  # of an automaton, which takes about 500 bytes a word
MOST_BITS = 1 << 30  # of the bit table, 128 MB
BITS_A_HASH, PROBES, SEGMENT = 32, 3, 1 << 16
TEXTS_A_SALT = 20_000  # texts of a block that one task streams


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST):
        self.least, self.ids, self.next, self.link, self.len = least, {}, [{}], [-1], [0]
        texts = []
        for item, ws in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            if len(seq) >= least:
                texts.append((item, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self.holders: dict[int, set[int]] = {}
        for item, seq in texts:
            s = 0
            for c in seq:
                s = self.next[s][c]
                t = self.top(s)
                if t:
                    self.holders.setdefault(t, set()).add(item)
        self.tops = [self.top(s) for s in range(len(self.len))]

    def parts(self) -> dict:
        """Plain values, for a broadcast."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, parts: dict) -> Automaton:
        a = cls.__new__(cls)
        a.__dict__.update(parts)
        return a

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def top(self, s: int) -> int:
        """The state of the last ``least`` words of the words of state s; 0 if s has fewer."""
        if self.len[s] < self.least:
            return 0
        while self.len[self.link[s]] >= self.least:
            s = self.link[s]
        return s

    def run(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, longest match that ends there, state of its last ``least`` words) where that is long enough."""
        s = n = 0
        ids, nxt, link, ln, least, tops = self.ids.get, self.next, self.link, self.len, self.least, self.tops
        for i, w in enumerate(ws):
            c = ids(w)
            if c is None:
                s = n = 0
                continue
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = ln[s]
                t = nxt[s].get(c)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n >= least:
                # n words match, which may be fewer than the state's longest word sequence
                while ln[link[s]] >= n:
                    s = link[s]
                yield i, n, tops[s]


MATCHES = "doc_id bigint, text string, item_ids array<bigint>, spans array<struct<lo:int,hi:int>>"
_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = _HASHES[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return h


def grams(ws: list[str], least: int) -> np.ndarray:
    """A 64-bit hash of every ``least`` words in a row."""
    if len(ws) < least:
        return np.zeros(0, dtype="uint64")
    h, out = np.fromiter((_hash(w) for w in ws), dtype="uint64", count=len(ws)), np.zeros(len(ws) - least + 1, dtype="uint64")
    with np.errstate(over="ignore"):
        for k in range(least):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def _bits_of(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """(probes, hashes) positions in a table of ``n_bits``, a power of two."""
    with np.errstate(over="ignore"):
        return np.stack([((hashes * np.uint64(2 * k + 1)) >> np.uint64(17 + 3 * k)) & np.uint64(n_bits - 1) for k in range(PROBES)]).astype("int64")


def pieces(items: DataFrame, least: int, most: int) -> DataFrame:
    """item_id, ws: the folded words of the items, long ones in overlapping pieces of at most ``most`` words."""
    step = max(1, most - least + 1)

    def run(batches):
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                ws = words(text)
                rows += [(item, ws[at : at + most]) for at in range(0, max(1, len(ws) - least + 1), step) if len(ws) >= least]
            yield pd.DataFrame(rows, columns=["item_id", "ws"])

    return spread(items.filter(F.col("text").isNotNull()).select("item_id", "text")).mapInPandas(run, "item_id bigint, ws array<string>")


def _probe(a: Automaton, pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of ``pdf`` with a match, the items that match and the runs of matched words."""
    out = []
    for doc, text in zip(pdf["doc_id"], pdf["text"]):
        tops, runs = set(), []
        for i, n, t in a.run(words(text)):
            tops.add(t)
            if runs and i - n + 1 <= runs[-1][1]:
                runs[-1] = (min(runs[-1][0], i - n + 1), i + 1)
            else:
                runs.append((i - n + 1, i + 1))
        if tops:
            out.append((doc, text, sorted({x for t in tops for x in a.holders[t]}), [{"lo": lo, "hi": hi} for lo, hi in runs]))
    return pd.DataFrame(out, columns=["doc_id", "text", "item_ids", "spans"])


def matches(docs: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, item_ids, spans (first word, word after the last): a row per text with a match and block of items.

    Null and empty texts, and items of fewer words, give no row; a text of any length is streamed whole."""
    sc = docs.sparkSession.sparkContext
    docs = spread(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"))
    parts = cut(pieces(items, least, block_words))
    total = parts.agg(F.sum(F.size("ws"))).first()[0] or 0
    if total > block_words:
        return _in_blocks(docs, parts, total, least, block_words)
    shared = sc.broadcast(Automaton([(r["item_id"], r["ws"]) for r in parts.orderBy("item_id").collect()], least).parts())  # at most block_words words

    def run(batches):
        a = Automaton.of(shared.value)
        for pdf in batches:
            yield _probe(a, pdf)

    return docs.mapInPandas(run, MATCHES)


def _in_blocks(docs: DataFrame, parts: DataFrame, total: int, least: int, block_words: int) -> DataFrame:
    spark = docs.sparkSession
    n_blocks = -(-2 * total // block_words)
    parts = cut(parts.withColumn("block", F.pmod(F.xxhash64("item_id", "ws"), F.lit(n_blocks)).cast("int")))

    def gram_rows(batches):
        for pdf in batches:
            got = [(np.unique(grams(list(ws), least)).view("int64"), b) for ws, b in zip(pdf["ws"], pdf["block"])]
            if got:
                yield pd.DataFrame({"gram": np.concatenate([g for g, _ in got]), "block": np.repeat([b for _, b in got], [len(g) for g, _ in got]).astype("int32")})

    known = cut(parts.select("ws", "block").mapInPandas(gram_rows, "gram bigint, block int").distinct())
    n_bits = SEGMENT
    while n_bits < min(MOST_BITS, BITS_A_HASH * known.count()):
        n_bits *= 2

    def marks(batches):
        for pdf in batches:
            at = np.unique(_bits_of(pdf["gram"].to_numpy(dtype="int64").view("uint64"), n_bits).ravel())
            yield pd.DataFrame({"segment": (at // SEGMENT).astype("int32"), "bit": (at % SEGMENT).astype("int32")})

    def segments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT, dtype=bool)
        bits[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    made = known.select("gram").mapInPandas(marks, "segment int, bit int").distinct().groupBy("segment").applyInPandas(segments, "segment int, bits binary")
    table = bytearray(n_bits // 8)
    for r in made.toLocalIterator():  # at most MOST_BITS in all
        table[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(table))

    def sift(batches):
        bits = np.frombuffer(shared.value, dtype="uint8")
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                g = np.unique(grams(words(text), least))
                if len(g):
                    at = _bits_of(g, n_bits)
                    g = g[((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)]
                if len(g):
                    out.append((doc, text, g.view("int64").tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "text", "grams"])

    kept = cut(docs.mapInPandas(sift, "doc_id bigint, text string, grams array<bigint>"))
    pairs = kept.select("doc_id", F.explode("grams").alias("gram")).join(known, "gram").select("doc_id", "block").distinct()
    texts = cut(kept.select("doc_id", "text").join(pairs, "doc_id"))
    salts = {r["block"]: -(-r["n"] // TEXTS_A_SALT) for r in texts.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per block
    many = {b: n for b, n in salts.items() if n > 1}
    n_salts = F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("block")], F.lit(1)) if many else F.lit(1)
    texts = texts.select("block", F.pmod(F.xxhash64("doc_id"), n_salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("array<string>").alias("ws"))
    parts = parts.select("block", F.explode(F.sequence(F.lit(0), (n_salts - 1).cast("int"))).alias("salt"), F.lit(0).alias("kind"), F.col("item_id").alias("doc_id"), F.lit(None).cast("string").alias("text"), "ws")
    both = texts.unionByName(parts).repartition(max(width(spark), n_blocks), "block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches):
        at, held, a = None, [], None
        for pdf in batches:
            for (block, salt, kind), part in pdf.groupby(["block", "salt", "kind"], sort=True):
                if (block, salt) != at:
                    at, held, a = (block, salt), [], None
                if kind == 0:
                    held += [(i, list(ws)) for i, ws in zip(part["doc_id"], part["ws"])]
                    continue
                if a is None:
                    a, held = Automaton(held, least), []
                yield _probe(a, part)

    return both.mapInPandas(run, MATCHES)


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Gives doc_id, item_id for every pair with ``least`` words in a row in common.

    Both are folded without case, accents, width, punctuation, apostrophes and spacing. Equal items are all reported;
    repeated rows count once. Empty inputs give an empty result."""
    return matches(docs, items, least, block_words).select("doc_id", F.explode("item_ids").alias("item_id")).distinct()


def spans(docs: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS, drop_share: float = 0.5) -> DataFrame:
    """Documents with a leak: doc_id, n_words, leaked_words, longest, action, cleaned.

    The matched words are removed from the text (``cut``); a document whose leaked share of words exceeds
    ``drop_share`` is dropped, with a null text. ``longest`` is the longest run of matched words. Documents without a
    leak give no row."""
    per = matches(docs, items, least, block_words).groupBy("doc_id", "text").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # the spans of one text

    def clean(batches):
        for pdf in batches:
            out = []
            for doc, text, all_spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                places = words_with_places(text)
                mark = np.zeros(len(places) + 2, dtype=bool)
                for s in all_spans:
                    mark[s["lo"] + 1 : s["hi"] + 1] = True
                edge = np.flatnonzero(mark[1:] != mark[:-1])
                lo, hi = edge[::2], edge[1::2]
                leaked = int(mark.sum())
                drop = leaked > drop_share * len(places)
                kept, at = [], 0
                for a, b in zip(lo, hi):
                    kept.append(text[at : places[a][1]])
                    at = places[b - 1][2]
                out.append((doc, len(places), leaked, int((hi - lo).max()), "drop" if drop else "cut", None if drop else "".join([*kept, text[at:]])))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "leaked_words", "longest", "action", "cleaned"])

    return per.mapInPandas(clean, "doc_id bigint, n_words int, leaked_words int, longest int, action string, cleaned string")
