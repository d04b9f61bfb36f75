"""Words of running text, and what may begin at each: one Arrow pass per text, whatever is looked for.

The pass gives few rows, not tokens: word sequences that may be dictionary keys or lexicon sequences, and cue phrases.
Keys and sequences are known to the pass by a bit table of fixed size, which holds a hash of each of them and of each of
their beginnings; it may let a wrong sequence through and never loses one, and an exact join follows. Every row carries
how many clause ends and scope-ending words stand before it, so rows of a text can be compared without the text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.session import spread

BITS = 1 << 26  # 8 MB
MAX_WORDS = 10
#: Words that the slots <det> and <obj> take.
DETERMINERS = ["my", "his", "her", "their", "your", "our", "its", "the", "a", "an", "both", "left", "right", "this", "that", "these", "those", "one", "some", "either"]
OBJECTS = ["me", "him", "her", "them", "you", "us"]
MOST_DETERMINERS = 3

TOKENS = "array<struct<start:int,end:int,w:string,brk:boolean,clause:boolean,upper:boolean>>"
_RUN = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)")
_PLAIN_GAP = frozenset([" ", "", "-", "  ", "\t", "/"])
_SOFT, _HARD = frozenset(",()[]"), frozenset(";.:!?\n")
_IES, _S = re.compile(r"(^|\s)\S{2,}ies$"), re.compile(r"(^|\s)\S{2,}[^sui\s]s$")
_known: dict[str, tuple[str, bool]] = {}


def fold_word(raw: str) -> str:
    """A word as ``normalize`` leaves it."""
    plain = raw if raw.isascii() else "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", re.sub("['’]", "", plain.lower())).strip()


def pieces(text: str | None):
    """(start, end, word, break before, clause end before, capitals) of each word, with code-point offsets.
    Null and empty texts have no words; what folds to nothing is part of the gap before the next word."""
    place, pending = 0, ""
    parts = _RUN.split(text or "")  # gap, word, gap, word, ..., gap
    for k in range(1, len(parts), 2):
        gap, raw = parts[k - 1], parts[k]
        start = place + len(gap)
        place = start + len(raw)
        known = _known.get(raw)
        if known is None:
            if len(_known) > 200_000:
                _known.clear()
            known = _known[raw] = fold_word(raw), raw.isupper()
        if not known[0]:
            pending += gap + raw
            continue
        if pending:
            gap, pending = pending + gap, ""
        hard = soft = False
        if gap not in _PLAIN_GAP:
            hard = not _HARD.isdisjoint(gap)
            soft = hard or not _SOFT.isdisjoint(gap)
        yield start, place, known[0], soft, hard, known[1]


def tokens(text) -> Column:
    """The tokens of a text column, in one Arrow stage."""

    @F.arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for t in texts.to_pylist():
            rows += pieces(t)
            ends.append(len(rows))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
        cols = list(zip(*rows)) if rows else [[]] * 6
        each = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["start", "end", "w", "brk", "clause", "upper"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return run(text)


def singular(term: str) -> str:
    """``text.singular`` of a string."""
    if not term.endswith("s"):
        return term
    if _IES.search(term):
        return term[:-3] + "y"
    return term[:-1] if _S.search(term) else term


def bit_table(keys: DataFrame, column: str) -> bytes:
    """A bit for the hash of every key and of every beginning of it in whole words; BITS / 8 bytes."""
    ws = F.split(column, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(ws)), lambda k: F.array_join(F.slice(ws, F.lit(1), k), " "))
    marked = F.concat(starts, F.array(F.concat(F.col(column), F.lit("\n"))))
    at = keys.filter(F.col(column) != "").select(F.explode(marked).alias("s")).select((F.pmod(F.crc32(F.col("s").cast("binary")), F.lit(BITS)) + 1).alias("p"))
    rows = at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out, size = bytearray(BITS // 8), 4096
    for r in rows.toLocalIterator():  # at most BITS / 32768 rows of 4 KB
        lo = (r["b"] - 1) * size
        out[lo : lo + size] = r["bits"]
    return bytes(out)


@dataclass
class Wanted:
    """What the pass looks for; everything here has a fixed size."""

    keys: bytes | None = None              # bit table of the dictionary
    sequences: bytes | None = None         # bit table of the lexicon's sequences
    parts: frozenset = frozenset()         # body parts that <part> takes
    before: dict = field(default_factory=dict)  # first word -> [(context, words)]; context -1: not a cue, and skipped
    after: dict = field(default_factory=dict)
    stops: frozenset = frozenset()         # words that end a scope
    years: int = -1                        # context that "in" and a year stand for


EVENTS = "doc_id bigint, kind int, context int, i int, n int, rank int, key string, part string, upper boolean, start int, end int, text string, clauses int, stops int"
TERM, SEQUENCE, BEFORE, AFTER = range(4)
_YEAR = re.compile(r"(19|20)\d\d$")


class _Pass:
    def __init__(self, want: Wanted):
        self.want = want
        self.flags: dict[str, int] = {}
        self.part_starts = frozenset(p.split()[0] for p in want.parts)
        has = lambda s: want.sequences is not None and self.begins(want.sequences, s)
        self.slot_part, self.slot_obj, self.slot_det = has("<part>"), has("<obj>"), has("<det>")

    @staticmethod
    def begins(table: bytes, s: str) -> int:
        h = zlib.crc32(s.encode()) % BITS
        return table[h >> 3] >> (h & 7) & 1

    def flag(self, w: str) -> int:
        """1: may begin a key, 2: may begin a sequence, 4: may begin a cue, 8: ends a scope."""
        want, f = self.want, 0
        if want.keys is not None and (w in X.ARTICLES or any(self.begins(want.keys, v) or self.begins(want.keys, v + "\n") for v in {w, X.NUMBER_WORDS.get(w, w), singular(w)})):
            f |= 1
        if want.sequences is not None and (self.slot_det or self.begins(want.sequences, w) or (self.slot_part and w in self.part_starts) or (self.slot_obj and w in OBJECTS)):
            f |= 2
        if w in want.before or w in want.after or (w == "in" and want.years >= 0):
            f |= 4
        if w in want.stops:
            f |= 8
        if len(self.flags) > 200_000:
            self.flags.clear()
        self.flags[w] = f
        return f

    def keys_at(self, words, brk, i):
        """(words, rank, key): variants of the sequences at i in the order in which they are tried."""
        table, size = self.want.keys, len(words)
        article = words[i] in X.ARTICLES
        forms = ["", "", "", ""]  # as written, digits, without articles, both
        for n in range(1, min(MAX_WORDS, size - i) + 1):
            w = words[i + n - 1]
            if n > 1 and brk[i + n - 1]:
                return
            d, sep = X.NUMBER_WORDS.get(w, w), " " if n > 1 else ""
            forms[0] += sep + w
            forms[1] += sep + d
            if w not in X.ARTICLES:
                forms[2] += sep + w
                forms[3] += sep + d
            tried = forms[:1] if article else forms if n > 2 else forms[:2]
            rank = 0
            for v in dict.fromkeys(x for f in dict.fromkeys(tried) for x in (f, singular(f))):
                if self.begins(table, v + "\n"):
                    yield n, rank, v
                rank += 1
            if not any(self.begins(table, v) for v in set(forms[:1] if article else forms)):
                return

    def sequences_at(self, words, brk, i):
        """(words, sequence, part): lexicon sequences at i; a slot takes all it can."""
        table, parts, size, todo = self.want.sequences, self.want.parts, len(words), [("", i, None)]
        while todo:
            s, j, part = todo.pop()
            if s and j > i and self.begins(table, s + "\n"):
                yield j - i, s, part
            steps = []
            if j < size and (j == i or not brk[j]):
                w = words[j]
                steps.append((w, j + 1, part))
                if self.slot_obj or s:
                    steps += [("<obj>", j + 1, part)] if w in OBJECTS else []
                if w in self.part_starts:
                    two = f"{w} {words[j + 1]}" if j + 1 < size and not brk[j + 1] else None
                    if two in parts:
                        steps.append(("<part>", j + 2, two))
                    elif w in parts:
                        steps.append(("<part>", j + 1, w))
            k = j
            while k < min(size, j + MOST_DETERMINERS) and (k == i or not brk[k]) and words[k] in DETERMINERS:
                k += 1
            steps.append(("<det>", k, part))
            for word, nxt, p in steps:
                longer = f"{s} {word}" if s else word
                if self.begins(table, longer):
                    todo.append((longer, nxt, p))

    @staticmethod
    def phrases_at(words, brk, i, table):
        """The longest phrase of each context at i that crosses no punctuation."""
        best: dict[int, int] = {}
        for context, phrase in table.get(words[i], ()):
            n = len(phrase)
            if n > best.get(context, 0) and tuple(words[i : i + n]) == phrase and not any(brk[i + 1 : i + n]):
                best[context] = n
        return best

    def rows(self, doc: int, text: str):
        toks = list(pieces(text))
        want, flags = self.want, self.flags
        words = [t[2] for t in toks]
        marks = [flags.get(w) for w in words]
        marks = [self.flag(w) if f is None else f for w, f in zip(words, marks)]
        if not any(marks):
            return
        brk = [t[3] for t in toks]
        clauses, stops = [0], [0]  # up to each word, itself excluded
        for t, f in zip(toks, marks):
            clauses.append(clauses[-1] + t[4])
            stops.append(stops[-1] + (f >> 3 & 1))
        for i, f in enumerate(marks):
            if f & 3:
                start = toks[i][0]
                if f & 1:
                    for n, rank, key in self.keys_at(words, brk, i):
                        end = toks[i + n - 1][1]
                        yield doc, TERM, 0, i, n, rank, key, None, all(t[5] for t in toks[i : i + n]), start, end, text[start:end], clauses[i + 1], stops[i]
                if f & 2:
                    for n, s, part in self.sequences_at(words, brk, i):
                        end = toks[i + n - 1][1]
                        yield doc, SEQUENCE, 0, i, n, 0, s, part, all(t[5] for t in toks[i : i + n]), start, end, text[start:end], clauses[i + 1], stops[i]
            if f & 4:
                found = self.phrases_at(words, brk, i, want.before)
                if -1 in found:
                    skipped = found.pop(-1)
                    found.pop(0, None)
                    yield doc, BEFORE, 0, i, skipped, -1, " ".join(words[i : i + skipped]), None, False, 0, 0, None, 0, 0
                for context, n in found.items():
                    yield doc, BEFORE, context, i, n, 0, " ".join(words[i : i + n]), None, False, 0, 0, None, clauses[i + n], stops[i + n]
                found = self.phrases_at(words, brk, i, want.after)
                if want.years >= 0 and want.years not in found and words[i] == "in" and i + 1 < len(words) and not brk[i + 1] and _YEAR.match(words[i + 1]):
                    found[want.years] = 2
                for context, n in found.items():
                    yield doc, AFTER, context, i, n, 0, " ".join(words[i : i + n]), None, False, 0, 0, None, clauses[i + 1], stops[i]


def events(docs: DataFrame, want: Wanted) -> DataFrame:
    """The rows of EVENTS for docs(doc_id, text): what may begin at each word of each text. Texts are read whole, once.

    clauses and stops count clause ends and scope-ending words: for terms, sequences and cues after a mention the clause
    ends up to word i and the words before it; for cues before a mention both up to the word after the cue."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(want.__dict__))  # plain values of a fixed size
    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(batches):
        one = _Pass(Wanted(**shared.value))
        for pdf in batches:
            got = [r for doc, text in zip(pdf["doc_id"], pdf["text"]) for r in one.rows(doc, text)]
            yield pd.DataFrame(got, columns=names)

    return spread(docs.filter(F.col("text").isNotNull()).select("doc_id", "text")).mapInPandas(run, EVENTS)


def phrases(docs: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """doc_id, cue, lo, hi: what may be a phrase of wanted(cue), of at most ``most`` words, in each text of docs(doc_id,
    text): once, with the place after its first occurrence and that of its last one. Punctuation does not part words. The
    bit table may let others through."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "cue"))

    def run(batches):
        table, known = shared.value, {}
        begins = _Pass.begins
        for pdf in batches:
            got = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words, places = [t[2] for t in pieces(text)], {}
                for i, w in enumerate(words):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 200_000:
                            known.clear()
                        f = known[w] = begins(table, w) | begins(table, w + "\n") << 1
                    if f & 2:
                        places[w] = (places[w][0] if w in places else i + 1), i
                    k = 2
                    while f & 1 and k <= most and i + k <= len(words):
                        w += " " + words[i + k - 1]
                        if begins(table, w + "\n"):
                            old = places.get(w)
                            places[w] = (i + k, i) if old is None else (min(old[0], i + k), i)
                        f, k = begins(table, w), k + 1
                got += [(doc, cue, lo, hi) for cue, (lo, hi) in places.items()]
            yield pd.DataFrame(got, columns=["doc_id", "cue", "lo", "hi"])

    return spread(docs.filter(F.col("text").isNotNull()).select("doc_id", "text")).mapInPandas(run, "doc_id bigint, cue string, lo int, hi int")
