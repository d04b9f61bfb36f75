"""Abusive, hateful or sexual content, by a factorization machine over hashed terms.

A text is scored sentence by sentence and has the score of its worst sentence. The terms of a sentence are its words,
pairs of words and marks of person and masking, hashed; the machine adds a weight for each term and the dot product of
the factors of each pair of terms, so an insult counts with a mention of ``you`` and not beside ``brace``. It is fitted
on general seed sentences and on human labels of whole documents, of which at most ``most`` are read. A document label
does not say which sentence it means: the sentences of a document labelled none are negative, and of one labelled
otherwise those are positive that the machine so far finds so, or whose terms stand out among the documents with a label
against those without. The machine has a fixed size; the texts are read once.

Each distinct token is folded and hashed once per worker; the terms of a batch of texts are then made and scored as whole
arrays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.abuse_seed import sentences as seed_sentences
from termloom.session import spread

BUCKETS = 1 << 17
FACTORS = 8
MOST_LABELS = 20_000
MOST_SENTENCES = 60_000
THRESHOLD = 0.5
LIFT = 8.0  # how much more frequent a term is among documents with a label than among those without
TEXTS_AT_ONCE = 1_000

_SPLIT = re.compile(r"(?<=[.!?;])[\s\"')]+|[\r\n]+")
_WRAP = re.compile(r"[ \t]+\r?\n[> ]*|\r?\n> +")  # lines broken inside a sentence
_CAPITAL = re.compile(r"(?<=[^\W_,]) (?=[A-Z][a-z']* )")
_SPEAKER = re.compile(r"^\s*[>\-*]*\s*[A-Za-zÀ-ÿ]{2,14}:\s+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){2,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e"})
_TOKEN = re.compile(r"[a-z0-9@$*€!#]+(?:'[a-z]+)?")
#: Words that mark who is spoken to or of.
_MARKS = {"#you": frozenset("you your yours you're you'll yourself u ur youre tu te toi ton ta tes t'es vous votre".split()),
          "#self": frozenset("i me my mine myself i'm i've i'd i'll je me moi mon ma mes".split()),
          "#they": frozenset("they them their he she him her his hers patient".split())}


def parts(text: str) -> list[str]:
    """The sentences of a text, without the names of speakers; long ones also cut at capitals, as a full stop may be missing."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _WRAP.sub(" ", text)
    out = [s for s in (_SPEAKER.sub("", p).strip() for p in _SPLIT.split(text)) if s]
    for s in out[:]:
        if s.count(" ") > 10:
            out += [f for f in _CAPITAL.split(s) if f.count(" ") > 1 and f != s]
    return out


def _letters(token: str) -> str:
    """A masked word as it was meant: digits and signs inside a word for letters, drawn-out letters once."""
    if not token.isalpha() and any(c.isalpha() for c in token) and not re.fullmatch(r"\d+[a-z]{1,3}|[a-z]\d+", token):
        token = token.rstrip("!").translate(_LEET)
    return re.sub(r"(.)\1{2,}", r"\1", token)


def _hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")


class Words:
    """Tokens as numbers: the hash of each word and the buckets of its marks, made once per distinct token."""

    MOST = 400_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes, self.marks = [_hash("^")], [()]  # number 0 bounds a sentence
        self.seen: tuple[int, np.ndarray] = (0, np.zeros(0, dtype="uint64"))

    def add(self, token: str) -> int:
        w = _letters(token)
        marks = []
        if w.isdigit() or not w.strip("!#"):
            self.ids[token] = -1
            return -1
        if "*" in w:
            marks.append("#masked")
        w = w.strip("!#")
        marks += [m for m, group in _MARKS.items() if w in group]
        if len(w) > 4 and w.endswith("s") and not w.endswith("ss"):
            marks.append(w[:-1])
        n = self.ids[token] = len(self.hashes)
        self.hashes.append(_hash(w))
        self.marks.append(tuple(_hash(m) % BUCKETS for m in marks))
        return n

    def array(self) -> np.ndarray:
        if self.seen[0] != len(self.hashes):
            self.seen = (len(self.hashes), np.array(self.hashes, dtype="uint64"))
        return self.seen[1]


_words = Words()


def featurize(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the terms of sentence i are buckets[ends[i]:ends[i + 1]]."""
    if len(_words.ids) > Words.MOST:
        _words.clear()
    flat, counts, get, add = [], [], _words.ids.get, _words.add
    for s in sentences:
        if not s.isascii():
            s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("’", "'")
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group(0)), s.lower())
        before = len(flat)
        flat.append(0)
        for t in _TOKEN.findall(s):
            n = get(t)
            if n is None:
                n = add(t)
            if n > 0:
                flat.append(n)
        if len(flat) == before + 1:
            flat.pop()
        counts.append(len(flat) - before)
    ws, n = np.array(flat, dtype="int64"), np.array(counts, dtype="int64")
    if not len(ws):
        return ws, np.zeros(len(sentences) + 1, dtype="int64")
    h = _words.array()[ws]
    row = np.repeat(np.arange(len(n)), n)
    after = np.append(h[1:], h[0])
    after[np.append(row[1:] != row[:-1], True)] = np.uint64(_words.hashes[0])  # the last word of a sentence is followed by its bound
    with np.errstate(over="ignore"):
        pair = (h * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xBF58476D1CE4E5B9)
    pair = ((pair >> np.uint64(31)) % np.uint64(BUCKETS)).astype("int64")
    inner = ws > 0
    one = (h[inner] % np.uint64(BUCKETS)).astype("int64")
    marks = _words.marks
    extra = [(r, m) for r, w in zip(row[inner].tolist(), ws[inner].tolist()) for m in marks[w]]
    rows = np.concatenate([row, row[inner], np.array([r for r, _ in extra], dtype="int64")])
    ids = np.concatenate([pair, one, np.array([m for _, m in extra], dtype="int64")])
    key = np.unique(rows * BUCKETS + ids)  # each term of a sentence once
    return key % BUCKETS, np.concatenate([[0], np.cumsum(np.bincount(key // BUCKETS, minlength=len(n)))])


def terms(sentence: str) -> list[int]:
    """Hashed terms of a sentence, each once."""
    return featurize([sentence])[0].tolist()


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.cumsum([0, *[len(r) for r in rows]])


def score(ids: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
    """Probability that each sentence is abusive, hateful or sexual; 0 for one without terms."""
    n = np.diff(ends)
    out, full = np.zeros(len(n)), n > 0
    if not full.any():
        return out
    at, scale = ends[:-1][full], 1 / np.sqrt(n[full])
    v = model["v"][ids]
    s, q = np.add.reduceat(v, at, axis=0) * scale[:, None], np.add.reduceat(np.einsum("ij,ij->i", v, v), at) * scale**2
    z = model["b"] + np.add.reduceat(model["w"][ids], at) + 0.5 * ((s * s).sum(axis=1) - q)
    out[full] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score_rows(rows: list[np.ndarray], model: dict) -> np.ndarray:
    return score(*_csr(rows), model) if rows else np.zeros(0)


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 10, rate: float = 0.08, decay: float = 2e-5, seed: int = 3) -> dict:
    """A factorization machine by AdaGrad on the logistic loss, in mini-batches."""
    rng = np.random.default_rng(seed)
    m = {"w": np.zeros(BUCKETS), "v": rng.normal(0, 0.05, (BUCKETS, FACTORS)), "b": -1.0}
    gw, gv, gb = np.full(BUCKETS, 1e-4), np.full((BUCKETS, FACTORS), 1e-4), 1e-4
    keep = np.array([i for i, r in enumerate(rows) if len(r)])
    for _ in range(epochs):
        order = rng.permutation(keep)
        for lo in range(0, len(order), 128):
            batch = order[lo : lo + 128]
            ix, ends = _csr([rows[i] for i in batch])
            n = np.diff(ends)
            row, at, scale = np.repeat(np.arange(len(batch)), n), ends[:-1], 1 / np.sqrt(n)
            v = m["v"][ix]
            s = np.add.reduceat(v, at, axis=0)
            q = np.add.reduceat(v * v, at, axis=0)
            z = m["b"] + np.add.reduceat(m["w"][ix], at) + 0.5 * ((s * s - q) * (scale**2)[:, None]).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch]
            dw = err[row]
            dv = (err * scale**2)[row][:, None] * (s[row] - v) + decay * v
            uniq, back = np.unique(ix, return_inverse=True)
            sw = np.bincount(back, dw, len(uniq)) + decay * m["w"][uniq]
            sv = np.zeros((len(uniq), FACTORS))
            np.add.at(sv, back, dv)
            gw[uniq] += sw**2
            gv[uniq] += sv**2
            gb += err.sum() ** 2
            m["w"][uniq] -= rate * sw / np.sqrt(gw[uniq])
            m["v"][uniq] -= rate * sv / np.sqrt(gv[uniq])
            m["b"] -= rate * err.sum() / np.sqrt(gb)
    return m


def train(labelled: pd.DataFrame, rounds: int = 2, most_sentences: int = MOST_SENTENCES) -> dict:
    """labelled: text, label (none or a kind of abuse).

    A sentence of a document with a label is taken as positive if the machine so far finds it so, or if half of its
    terms are much more frequent among the documents with a label than among those without; as negative if its terms
    are not. Of the sentences of documents without a label at most ``most_sentences`` are taken, by hash. Without labels
    the seed alone is used."""
    seed, seed_y = seed_sentences()
    rows_of = lambda ss: (lambda ids, ends: [ids[a:b] for a, b in zip(ends[:-1], ends[1:])])(*featurize(ss))
    base, y0 = rows_of(seed), np.array(seed_y, dtype=float)
    bad = (labelled["label"] != "none").to_numpy(dtype=bool)
    texts = [list(dict.fromkeys(parts(t))) for t in labelled["text"]]
    docs = [[r for r in rows_of(ss) if len(r)] for ss in texts]
    plain = {s: None for ss, b in zip(texts, bad) if not b for s in ss}
    clean = [r for r in rows_of(sorted(plain, key=lambda s: (_hash(s), s))[:most_sentences]) if len(r)]
    bad_docs = [rs for rs, b in zip(docs, bad) if b and rs]
    here, there = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for rs, b in zip(docs, bad):
        if rs:
            (here if b else there)[np.unique(np.concatenate(rs))] += 1
    n_bad, n_none = max(1, len(bad_docs)), max(1, int((~bad).sum()))
    lift = ((here + 0.1) / n_bad) / ((there + 0.5) / n_none)
    odd_term, common = (lift >= LIFT) & (here >= 2), (lift < 2) & (there >= 0.002 * n_none)
    model = fit(base, y0, np.ones(len(base)))
    for _ in range(rounds if len(labelled) else 0):
        rows, y, w = [*base], [*y0], [0.5] * len(base)
        for r, q in zip(clean, score_rows(clean, model)):
            if q < 0.9:  # else the label may be wrong
                rows.append(r)
                y.append(0.0)
                w.append(0.5)
        for rs in bad_docs:
            p = score_rows(rs, model)
            for r, q in zip(rs, p):
                odd = odd_term[r].mean()
                if odd >= 0.5 or (q >= 0.5 and odd >= 0.15):
                    rows.append(r)
                    y.append(1.0)
                    w.append(1.0)
                elif common[r].mean() >= 0.7:
                    rows.append(r)
                    y.append(0.0)
                    w.append(0.5)
        model = fit(rows, np.array(y), np.array(w))
    return {"w": model["w"].astype("float32"), "v": model["v"].astype("float32"), "b": float(model["b"])}


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> pd.DataFrame:
    """At most ``most`` labels with their texts, chosen by hash; a document with several labels has one row each."""
    lab = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
    lab = F.broadcast(lab.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most))
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(lab, "doc_id").select("doc_id", "text", "label").orderBy("doc_id", "label").toPandas()


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, source, score. Null, empty and wordless texts score 0; a text is scored whole, at any length; repeated
    rows score alike. Empty inputs give an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            m, texts = shared.value, pdf["text"].tolist()
            for lo in range(0, len(texts), TEXTS_AT_ONCE):
                chunk = [parts(t) if isinstance(t, str) else [] for t in texts[lo : lo + TEXTS_AT_ONCE]]
                n, best = np.array([len(c) for c in chunk]), np.zeros(len(chunk))
                p = score(*featurize([s for c in chunk for s in c]), m)
                if len(p):
                    best[n > 0] = np.maximum.reduceat(p, (np.cumsum(n) - n)[n > 0])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo : lo + TEXTS_AT_ONCE], "source": pdf["source"].iloc[lo : lo + TEXTS_AT_ONCE], "score": np.round(best, 6)})

    return spread(docs.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, those at or above the threshold, and their share."""
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return scored.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), hit.alias("n_found"), F.round(hit / F.count(F.lit(1)), 6).alias("found_share"), F.round(F.avg("score"), 4).alias("mean_score"))
