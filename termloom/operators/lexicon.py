"""Lexicon patterns: expansion to word sequences with slots, matching, and what their targets stand for.

``[a|b]`` is a choice and nests, ``x?`` and ``[..]?`` are optional, ``<slot>`` takes a body part, determiners or an
object. Patterns are expanded in an Arrow stage, row by row; the pass over the texts (``tokens``) finds what may be a
sequence and a join tells which it is, so any number of patterns can be run. Targets are filled and looked up once for
each pattern and body part that occur.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import annotate as A
from termloom.operators import tokens as T
from termloom.operators.tokens import fold_word as _fold
from termloom.session import cut

PART = "word string, part string, adjective string, pain string"


def expand(pattern: str) -> list[tuple[str, ...]]:
    """All sequences of a pattern, each once, shortest choice last; slots keep their angle brackets."""
    text = pattern.strip()
    pos = 0

    def choice(stop_at_bracket: bool) -> list[list[tuple[str, ...]]]:
        nonlocal pos
        alternatives, here = [], [()]
        while pos < len(text):
            c = text[pos]
            if c == "]" and stop_at_bracket:
                break
            if c == "|" and stop_at_bracket:
                alternatives.append(here)
                here = [()]
                pos += 1
                continue
            if c.isspace():
                pos += 1
                continue
            if c == "[":
                pos += 1
                inner = [s for alt in choice(True) for s in alt]
                pos += 1
            else:
                end = pos
                while end < len(text) and not text[end].isspace() and text[end] not in "[" + ("]|" if stop_at_bracket else ""):
                    end += 1
                word = text[pos:end]
                pos = end
                bare = word.rstrip("?")
                inner = [(bare,) if bare.startswith("<") and bare.endswith(">") else tuple(_fold(bare).split())]
                if bare != word:
                    inner.append(())
            if pos < len(text) and text[pos] == "?":
                inner.append(())
                pos += 1
            here = [a + b for a in here for b in inner]
        alternatives.append(here)
        return alternatives

    return list(dict.fromkeys(s for alt in choice(False) for s in alt if s))


def sequences(patterns: DataFrame) -> DataFrame:
    """pattern_id, seq_no, seq (array<string>) for patterns(pattern_id, pattern); null and empty patterns have none."""

    @F.pandas_udf("array<array<string>>")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: [list(s) for s in expand(x)] if x else [])

    return patterns.select("pattern_id", F.posexplode(run("pattern")).alias("seq_no", "seq"))


def compiled(patterns: DataFrame) -> DataFrame:
    """seq, pattern_id, capitals: the sequences of patterns(pattern_id, pattern, and, if there, case), the least id of each.

    A pattern whose ``case`` is ``upper`` matches capitals only."""
    upper = F.coalesce(F.lower("case") == "upper", F.lit(False)) if "case" in patterns.columns else F.lit(False)
    rows = sequences(patterns.select("pattern_id", "pattern")).join(patterns.select("pattern_id", upper.alias("capitals")), "pattern_id")
    return rows.groupBy(F.array_join("seq", " ").alias("seq"), "capitals").agg(F.min("pattern_id").alias("pattern_id"))


def found(events: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, i, n, pattern_id, part: the longest pattern at each token; the smaller id on ties."""
    hit = events.filter(F.col("kind") == T.SEQUENCE).join(lexicon, events["key"] == lexicon["seq"]).filter(~F.col("capitals") | F.col("upper"))
    best = hit.groupBy("doc_id", "i").agg(F.min(F.struct((-F.col("n")).alias("less"), "pattern_id", "part")).alias("b"))
    return best.select("doc_id", "i", (-F.col("b.less")).cast("int").alias("n"), "b.pattern_id", "b.part")


def matches(docs: DataFrame, patterns: DataFrame, parts: list[str]) -> DataFrame:
    """``found`` for docs(doc_id, text): the longest pattern at each token. ``parts`` are the body parts the slot takes, a
    fixed list. A match crosses no punctuation."""
    lexicon = cut(compiled(patterns))
    spark = docs.sparkSession
    words = spark.createDataFrame([(p,) for p in parts], "word string")
    return found(A.spotted(docs, lexicon=lexicon, parts=words), lexicon)


def options(hits: DataFrame, targets: DataFrame, parts: DataFrame, terms: DataFrame, concept: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, i, n, suppressed, candidates, extra: what the lexicon matches ``found`` stand for, by ``choices``."""
    both = choices(hits, targets, parts, A.top_candidates(terms), concept, codes)
    return hits.withColumn("ref", ref()).join(both, "ref").select("doc_id", "i", "n", "suppressed", "candidates", "extra")


def ref(pattern: str = "pattern_id", part: str = "part") -> Column:
    """A name of a pattern and body part; no key of a dictionary has a line end."""
    return F.concat(F.col(pattern).cast("string"), F.lit("\n"), F.coalesce(part, F.lit("")))


def choices(hits: DataFrame, targets: DataFrame, parts: DataFrame, top: DataFrame, concept: DataFrame, codes: DataFrame) -> DataFrame:
    """ref, suppressed, candidates, extra: what each pattern and body part of the matches ``found`` stands for.

    targets: pattern_id, item_pos, item; parts: word, part, adjective, pain. A target is ``-`` (the match is suppressed),
    a code ``vocabulary:code``, or a term of the dictionary, with codes added after ``+``; {part}, {adj} and {pain} are
    filled from the body part, and a target whose slot has no value is left out. Of the targets that resolve, the one
    whose first concept has codes in the most vocabularies comes first, the others' first concepts after it. Matches
    of which no target resolves give no row. Each pattern and body part is resolved once."""
    pairs = hits.select("pattern_id", "part").distinct().withColumnRenamed("part", "word")
    fill = parts.groupBy("word").agg(*[F.min(c).alias(c) for c in ("part", "adjective", "pain")])
    t = pairs.join(targets.select("pattern_id", "item_pos", "item"), "pattern_id").join(fill, "word", "left")
    item = F.col("item")
    for slot, c in (("{part}", "part"), ("{adj}", "adjective"), ("{pain}", "pain")):
        item = F.when(~item.contains(slot), item).when(F.col(c).isNotNull(), F.replace(item, F.lit(slot), F.col(c)))
    t = t.withColumn("item", item).filter("item is not null")
    off = t.filter("trim(item) = '-'").select("pattern_id", "word").distinct().withColumn("off", F.lit(True))
    bits = F.transform(F.split("item", r"\+"), lambda x: F.trim(x))
    t = cut(t.filter("trim(item) <> '-'").select("pattern_id", "word", "item_pos", bits[0].alias("main"), F.slice(bits, 2, 100).alias("more")))
    spec = r"^([A-Za-z0-9_]+):(\S+)$"
    code = concept.select(F.upper("vocabulary_id").alias("v_"), F.col("code").alias("c_"), F.col("concept_id").alias("code_id"), F.col("name").alias("code_name"), F.col("vocabulary_id").alias("vocabulary"))
    lead = lambda c, k: F.regexp_extract(c, spec, k)
    by_code = t.filter(F.col("main").rlike(spec)).join(code, (F.upper(lead("main", 1)) == F.col("v_")) & (lead("main", 2) == F.col("c_")))
    by_code = by_code.select("pattern_id", "word", "item_pos", F.array(F.struct(F.lit(1).alias("r"), F.col("code_id").alias("concept_id"), F.lit(1.0).alias("score"), F.col("main").alias("term"), F.lit("curated").alias("term_type"))).cast(A.CANDIDATES).alias("c"))
    norm = X.normalize(F.col("main"))
    bare = F.when(F.size(F.split(norm, " ")) > 2, F.array_join(F.filter(F.split(norm, " "), lambda w: ~w.isin(X.ARTICLES)), " ")).otherwise(norm)
    asked = t.filter(~F.col("main").rlike(spec)).select("pattern_id", "word", "item_pos", "main", F.posexplode(F.array_distinct(F.array(norm, X.singular(norm), bare, X.singular(bare)))).alias("rank", "key"))
    by_term = asked.join(top.drop("keep"), "key").groupBy("pattern_id", "word", "item_pos").agg(F.min_by(F.struct("main", "candidates"), "rank").alias("b"))
    first = F.col("b.candidates")[0]
    curated = F.struct(first["r"].alias("r"), first["concept_id"].alias("concept_id"), F.lit(1.0).alias("score"), F.col("b.main").alias("term"), F.lit("curated").alias("term_type"))
    by_term = by_term.select("pattern_id", "word", "item_pos", F.concat(F.array(curated), F.slice("b.candidates", 2, A.MAX_CANDIDATES)).cast(A.CANDIDATES).alias("c"))
    added = t.select("pattern_id", "word", "item_pos", F.posexplode("more").alias("p", "x")).join(code, (F.upper(lead("x", 1)) == F.col("v_")) & (lead("x", 2) == F.col("c_")))
    added = added.groupBy("pattern_id", "word", "item_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("vocabulary").alias("vocabulary_id"), F.col("c_").alias("code")))), lambda x: F.struct(x["vocabulary_id"], x["code"])).alias("extra"))
    got = by_code.unionByName(by_term).join(_null_safe(added), _on_option(), "left").drop("p_", "w_", "i_")
    got = got.withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<vocabulary_id:string,code:string>>")))
    reach = codes.groupBy("concept_id").agg(F.collect_set("vocabulary_id").alias("vs"))  # at most the vocabularies
    got = got.withColumn("concept_id", F.col("c")[0]["concept_id"]).join(reach, "concept_id", "left")
    n = F.size(F.array_union(F.coalesce("vs", F.array().cast("array<string>")), F.transform("extra", lambda x: x["vocabulary_id"])))
    rows = got.groupBy("pattern_id", "word").agg(F.array_sort(F.collect_list(F.struct((-n).alias("less"), "item_pos", "c", "extra"))).alias("o"))  # the targets of a pattern
    rest = F.transform(F.slice("o", 2, 1000), lambda x: x["c"][0])
    chain = F.aggregate(rest, F.col("o")[0]["c"], lambda a, c: F.when(F.exists(a, lambda x: x["concept_id"] == c["concept_id"]), a).otherwise(F.concat(a, F.array(c))))
    best = rows.select("pattern_id", "word", F.slice(chain, 1, A.MAX_CANDIDATES).alias("candidates"), F.col("o")[0]["extra"].alias("extra"))
    both = best.join(off, (best["pattern_id"] == off["pattern_id"]) & best["word"].eqNullSafe(off["word"]), "full").select(
        F.coalesce(best["pattern_id"], off["pattern_id"]).alias("pattern_id"), F.coalesce(best["word"], off["word"]).alias("word"), F.coalesce("off", F.lit(False)).alias("suppressed"), "candidates", "extra")
    both = both.withColumn("candidates", F.coalesce("candidates", F.array().cast(A.CANDIDATES))).withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<vocabulary_id:string,code:string>>")))
    return both.select(ref("pattern_id", "word").alias("ref"), "suppressed", "candidates", "extra")


def _null_safe(added: DataFrame) -> DataFrame:
    return added.select(F.col("pattern_id").alias("p_"), F.col("word").alias("w_"), F.col("item_pos").alias("i_"), "extra")


def _on_option():
    return (F.col("pattern_id") == F.col("p_")) & F.col("word").eqNullSafe(F.col("w_")) & (F.col("item_pos") == F.col("i_"))


def unresolved(targets: DataFrame, parts: DataFrame, terms: DataFrame, concept: DataFrame) -> DataFrame:
    """pattern_id, item_pos, target: filled targets that name no code and no term, for a check of the lexicon."""
    every = targets.select("pattern_id", "item_pos", F.trim(F.split("item", r"\+")[0]).alias("target"))
    slotted = F.col("target").contains("{")
    fill = parts.select("part", "adjective", "pain").distinct().collect()  # a fixed list of body parts
    each = F.array(*[F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in ("part", "adjective", "pain")]) for r in fill]) if fill else F.array().cast("array<struct<part:string,adjective:string,pain:string>>")
    filled_ = every.filter(slotted).withColumn("f_", F.explode(each)).select("pattern_id", "item_pos", "target", "f_.*")
    for slot, c in (("{part}", "part"), ("{adj}", "adjective"), ("{pain}", "pain")):
        x = F.col("target")
        filled_ = filled_.withColumn("target", F.when(~x.contains(slot), x).when(F.col(c).isNotNull(), F.replace(x, F.lit(slot), F.col(c)))).filter("target is not null")
    t = every.filter(~slotted).filter("target <> '-'").unionByName(filled_.select("pattern_id", "item_pos", "target"))
    spec = r"^([A-Za-z0-9_]+):(\S+)$"
    code = concept.select(F.upper("vocabulary_id").alias("v_"), F.col("code").alias("c_"))
    bad_code = t.filter(F.col("target").rlike(spec)).join(code, (F.upper(F.regexp_extract("target", spec, 1)) == F.col("v_")) & (F.regexp_extract("target", spec, 2) == F.col("c_")), "left_anti")
    norm = X.normalize(F.col("target"))
    keys = terms.select("key").distinct()
    bare = F.array_join(F.filter(F.split(norm, " "), lambda w: ~w.isin(X.ARTICLES)), " ")
    plain = t.filter(~F.col("target").rlike(spec))
    named = plain.withColumn("key", F.explode(F.array_distinct(F.array(norm, X.singular(norm), bare, X.singular(bare))))).join(keys, "key").select("pattern_id", "item_pos", "target").distinct()
    plain = plain.join(named, ["pattern_id", "item_pos", "target"], "left_anti")
    return bad_code.unionByName(plain).select("pattern_id", "item_pos", "target").distinct()


def filled(target: str, part: str | None, adjective: str | None = None, pain: str | None = None) -> str | None:
    """A target with its slots filled; null if a slot has no value."""
    values = {"{part}": part, "{adj}": adjective, "{pain}": pain}
    for k, v in values.items():
        if k in target:
            if not v:
                return None
            target = target.replace(k, v)
    return target
