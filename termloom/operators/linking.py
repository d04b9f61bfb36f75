"""Linking concepts to codes by their names, as a handful of equi-joins.

Every rule yields offers (concept, code, score, how); the best offer of a pair wins. No rule compares all pairs: exact
names and word sets join on a key, contained word sets join on the rarest word of the concept's set and are verified,
broader ones join on the set with one word dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.session import cut

#: Weights and limits of the rules.
TARGET_WEIGHT = {"preferred": 1.0, "clinical": 0.9, "index": 0.8}
SOURCE_WEIGHT = {"clinical": 1.0, "preferred": 1.0, "lay": 0.9}
EXACT, UNSPECIFIED, WORDS, CONTAINED, BROADER = 1.0, 0.95, 0.85, 0.6, 0.55
GEM_EXACT, GEM_APPROX = 0.8, 0.7
MAX_EXTRA, MAX_CODES, CONTEXT_PENALTY, MANIFESTATION_PENALTY = 2, 6, 0.5, 0.5
HOW = ["name", "words", "contained", "broader", "gem"]
DIAGNOSES = ["condition", "symptom", "observation", "other"]
TARGETS = {"ICD10CM": DIAGNOSES, "ICD9CM": [*DIAGNOSES, "procedure"], "NS_MSI": ["procedure", "other", "observation"]}
MIN_SHARE, SIBLING = 0.2, 0.6


@dataclass
class Names:
    """What the rules read: concepts with a domain, codes with a title, and the terms of both."""

    concept: DataFrame
    synonym: DataFrame
    source_vocabulary: str = "UMLS"
    targets: dict = field(default_factory=lambda: dict(TARGETS))
    target_types: dict = field(default_factory=lambda: dict(TARGET_WEIGHT))
    source_types: dict = field(default_factory=lambda: dict(SOURCE_WEIGHT))

    def _weight(self, table: dict, default: float | None) -> Column:
        out = F.lit(default)
        for k, v in table.items():
            out = F.when(F.col("term_type") == k, F.lit(v)).otherwise(out)
        return out

    def sources(self) -> DataFrame:
        """cui, domain, norm, key, weight: distinct usable terms of the concepts."""
        c = self.concept.filter((F.col("vocabulary_id") == self.source_vocabulary) & F.col("valid_end").isNull()).select(F.col("concept_id").alias("cui"), "domain")
        s = self.synonym.filter(F.col("term_type").isin(list(self.source_types)) & F.col("term").isNotNull())
        s = s.select(F.col("concept_id").alias("cui"), "term", self._weight(self.source_types, None).alias("weight"))
        t = c.join(s, "cui").withColumn("norm", X.normalize(F.col("term"))).withColumn("ws", X.word_set(F.col("term")))
        return t.select("cui", "domain", "norm", F.col("ws.key").alias("key"), "weight").groupBy("cui", "domain", "norm", "key").agg(F.max("weight").alias("weight"))

    def codes(self) -> DataFrame:
        return self.concept.filter(F.col("vocabulary_id").isin(list(self.targets))).select(F.col("concept_id").alias("code_id"), "vocabulary_id", F.col("domain").alias("code_domain"), F.col("name").alias("title"), "valid_end")

    def target_terms(self) -> DataFrame:
        s = self.synonym.filter(F.col("term").isNotNull()).select(F.col("concept_id").alias("code_id"), "term", self._weight(self.target_types, 0.8).alias("w"))
        t = self.codes().filter(F.col("valid_end").isNull()).select("code_id", "vocabulary_id").join(s, "code_id")
        return t.withColumn("norm", X.normalize(F.col("term"))).withColumn("ws", X.word_set(F.col("term")))

    def wanted(self) -> DataFrame:
        """The sources once per vocabulary that may hold their kind."""
        pairs = F.array(*[F.struct(F.lit(v).alias("v"), X.listed(d).alias("d")) for v, d in self.targets.items()])
        t = self.sources().withColumn("target", F.explode(pairs)).filter(F.array_contains("target.d", F.col("domain")))
        return t.select("cui", "domain", "norm", "key", F.array_join("key", " ").alias("ks"), "weight", F.col("target.v").alias("vocabulary_id"))


def exact_index(n: Names) -> DataFrame:
    return n.target_terms().groupBy("vocabulary_id", "norm", "code_id").agg(F.max("w").alias("w"))


def word_index(n: Names) -> DataFrame:
    """vocabulary_id, ks, key, code_id, w, unspecified: word sets that name at most MAX_CODES codes."""
    t = n.target_terms().filter("ws.key is not null").groupBy("vocabulary_id", F.array_join("ws.key", " ").alias("ks"), "code_id").agg(
        F.max(F.struct("w", F.col("ws.unspecified").alias("unspecified"))).alias("b"), F.first("ws.key").alias("key"))
    few = t.groupBy("vocabulary_id", "ks").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= MAX_CODES).drop("n")
    return t.join(few, ["vocabulary_id", "ks"]).select("vocabulary_id", "ks", "key", "code_id", "b.w", "b.unspecified")


def name_offers(wanted: DataFrame, exact: DataFrame) -> DataFrame:
    return wanted.join(exact, ["vocabulary_id", "norm"]).select("cui", "vocabulary_id", "code_id", (F.lit(EXACT) * F.col("w") * F.col("weight")).alias("score"), F.lit("name").alias("how"))


def word_offers(wanted: DataFrame, words: DataFrame) -> DataFrame:
    base = F.when(F.col("unspecified"), UNSPECIFIED).otherwise(WORDS)
    return wanted.filter("key is not null").drop("key").join(words, ["vocabulary_id", "ks"]).select("cui", "vocabulary_id", "code_id", (base * F.col("w") * F.col("weight")).alias("score"), F.lit("words").alias("how"))


def contained_offers(left: DataFrame, words: DataFrame) -> DataFrame:
    """Target sets with every word of the concept's set and at most MAX_EXTRA more, none of them of another context."""
    sets = words.select("vocabulary_id", "ks", F.col("key").alias("target")).distinct()
    postings = sets.select("vocabulary_id", F.explode("target").alias("word"), "ks", "target")
    often = postings.groupBy("vocabulary_id", "word").agg(F.count(F.lit(1)).alias("n"))
    keys = left.select("vocabulary_id", "ks", "key").distinct()
    each = keys.select("vocabulary_id", "ks", "key", F.explode("key").alias("word")).join(often, ["vocabulary_id", "word"], "left")
    rare = each.groupBy("vocabulary_id", F.col("ks").alias("mine")).agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"), F.min(F.coalesce("n", F.lit(0))).alias("n"), F.first("key").alias("key"))
    hit = rare.filter("n > 0").join(postings, ["vocabulary_id", "word"])
    extra = F.array_except("target", "key")
    hit = hit.filter((F.size(F.array_except("key", "target")) == 0) & (F.size(extra) <= MAX_EXTRA) & ~F.arrays_overlap(extra, X.listed(X.CONTEXT_WORDS)))
    hit = hit.select("vocabulary_id", "mine", "ks", F.size(extra).alias("extra")).join(words.drop("key"), ["vocabulary_id", "ks"]).drop("ks")
    got = left.withColumnRenamed("ks", "mine").join(hit, ["vocabulary_id", "mine"])
    return got.select("cui", "vocabulary_id", "code_id", (F.lit(CONTAINED) * F.col("w") * F.col("weight") * F.pow(F.lit(0.9), "extra")).alias("score"), F.lit("contained").alias("how"))


def broader_offers(left: DataFrame, words: DataFrame) -> DataFrame:
    """Target sets that are the concept's set without one word; a single word left must name a disease."""
    shorter = left.select("cui", "vocabulary_id", "weight", F.explode(F.transform("key", lambda w: F.array_remove("key", w))).alias("rest"))
    shorter = shorter.filter((F.size("rest") > 1) | F.col("rest")[0].rlike(X.DISEASE_WORD)).withColumn("ks", F.array_join("rest", " "))
    return shorter.join(words.drop("key"), ["vocabulary_id", "ks"]).select("cui", "vocabulary_id", "code_id", (F.lit(BROADER) * F.col("w") * F.col("weight")).alias("score"), F.lit("broader").alias("how"))


def penalised(pairs: DataFrame, n: Names) -> DataFrame:
    """Adds penalty: halved if the title sets a context the concept never has, and again for a manifestation."""
    c = n.concept.filter(F.col("vocabulary_id") == n.source_vocabulary).select(F.col("concept_id").alias("cui"))
    own = n.synonym.filter(~F.col("source").isin("UMLS/ICD9CM", "UMLS/ICD10CM")).select(F.col("concept_id").alias("cui"), F.explode(F.split(X.normalize(F.col("term")), " ")).alias("w")).join(c, "cui", "left_semi")
    own = own.select("cui", X.token_fold(F.col("w")).alias("w")).filter(F.col("w").isin(X.CONTEXT_WORDS)).groupBy("cui").agg(F.collect_set("w").alias("own"))  # at most the context words
    kept = F.regexp_replace("title", r"(?i)\b(without|except|excluding|other than)\b[^,;]*", " ")
    said = F.array_intersect(F.transform(F.split(X.normalize(kept), " "), X.token_fold), X.listed(X.CONTEXT_WORDS))
    codes = n.codes().select("code_id", "code_domain", said.alias("said"), F.col("title").rlike(X.MANIFESTATION).alias("manifests"))
    out = pairs.join(codes, "code_id", "left").join(own, "cui", "left")
    foreign = F.size(F.array_except(F.coalesce("said", F.array().cast("array<string>")), F.coalesce("own", F.array().cast("array<string>")))) > 0
    p = F.when(foreign, F.lit(CONTEXT_PENALTY)).otherwise(F.lit(1.0)) * F.when(F.coalesce("manifests", F.lit(False)), F.lit(MANIFESTATION_PENALTY)).otherwise(F.lit(1.0))
    return out.withColumn("penalty", p).drop("said", "manifests", "own")


def best_offers(offers: DataFrame) -> DataFrame:
    rank = F.array_position(X.listed(HOW), F.col("how"))
    return offers.groupBy("cui", "code_id").agg(F.max("score").alias("score"), F.max_by("how", F.struct("score", -rank)).alias("how"))


def link(n: Names, edges: DataFrame) -> DataFrame:
    """cui, code_id, score, how for every pair the rules find, without pairs that have a direct link.

    edges: concept_id_1, concept_id_2, relationship_id, confidence, source. Terms that are null give nothing; repeated
    terms count once. Ties go to the rule named first in HOW. An empty input gives an empty result."""
    wanted, exact, words = cut(n.wanted()), exact_index(n), cut(word_index(n))
    named = cut(name_offers(wanted, exact).unionByName(word_offers(wanted, words)))
    done = named.select("cui", "vocabulary_id").distinct()
    left = wanted.filter(F.size("key") >= 2).join(done, ["cui", "vocabulary_id"], "left_anti").groupBy("cui", "vocabulary_id", "ks").agg(F.first("key").alias("key"), F.max("weight").alias("weight"))
    offers = named.unionByName(contained_offers(left, words)).unionByName(broader_offers(left, words)).drop("vocabulary_id")
    domains = n.concept.filter(F.col("vocabulary_id") == n.source_vocabulary).select(F.col("concept_id").alias("cui"), "domain")

    def judged(o: DataFrame) -> DataFrame:
        o = penalised(o.join(domains, "cui", "left"), n)
        ok = X.compatible(F.coalesce("domain", F.lit("other")), F.coalesce("code_domain", F.lit("condition")))
        return o.filter(ok).select("cui", "code_id", F.round(F.col("score") * F.col("penalty"), 3).alias("score"), "how")

    best = cut(best_offers(judged(offers)))
    direct = edges.filter(F.col("relationship_id") == "umls_cui_of").select(F.col("concept_id_1").alias("cui"), F.col("concept_id_2").alias("code_id")).distinct().join(domains.select("cui"), "cui", "left_semi")
    certain = cut(penalised(direct, n).select("cui", "code_id", F.col("penalty").alias("score")))
    seeds = best.join(certain, ["cui", "code_id"], "left_anti").select("cui", "code_id", "score").unionByName(certain)
    hop = edges.filter(F.col("source").isin("CMS_GEM", "GEM_DERIVED")).select(F.col("concept_id_1").alias("code_id"), F.col("concept_id_2").alias("other"),
        F.coalesce("confidence", F.when(F.col("relationship_id").isin("maps_to", "mapped_from"), GEM_EXACT).otherwise(GEM_APPROX)).alias("factor")).distinct()
    over = seeds.join(hop, "code_id").select("cui", F.col("other").alias("code_id"), (F.col("score") * F.col("factor")).alias("score"), F.lit("gem").alias("how"))
    over = over.join(certain.select("cui", "code_id"), ["cui", "code_id"], "left_anti")
    return best_offers(best.unionByName(judged(over))).join(certain.select("cui", "code_id"), ["cui", "code_id"], "left_anti")


def certain_links(n: Names, edges: DataFrame) -> DataFrame:
    """Direct links with the confidence the penalties leave; null where nothing is taken off."""
    direct = edges.filter(F.col("relationship_id") == "umls_cui_of").select(F.col("concept_id_1").alias("cui"), F.col("concept_id_2").alias("code_id")).distinct()
    return penalised(direct, n).select("cui", "code_id", F.when(F.col("penalty") < 1, F.col("penalty")).alias("confidence"))


def rollup(nodes: DataFrame, parents: DataFrame, own: DataFrame, top: int = 5) -> DataFrame:
    """Mappings derived for nodes without one, from the mapped nodes nearest below, else from unspecified siblings.

    nodes: node, title, concept_class; parents: node, parent; own: node, target. A mapped node counts with its weight
    and hides what is below it. The walk goes up from each mapped node and stops below the next mapped one; its rounds
    are bounded by the depth of the hierarchy, and each moves (mapped node, ancestor) pairs only."""
    title = F.lower("title")
    weight = F.when(title.rlike("subsequent encounter|sequela"), 0.0).when(title.contains("open fracture"), 0.5).otherwise(1.0)
    mapped = own.select("node").distinct()
    parents = parents.filter(F.col("parent").isNotNull()).select("node", "parent").distinct()
    front = cut(mapped.join(nodes.select("node", weight.alias("w")), "node").join(parents, "node").select(F.col("node").alias("origin"), F.col("parent").alias("node"), "w").join(mapped, "node", "left_anti"))
    seen = front
    while not front.isEmpty():
        front = cut(front.join(parents, "node").select("origin", F.col("parent").alias("node"), "w").join(mapped, "node", "left_anti").join(seen.select("origin", "node"), ["origin", "node"], "left_anti").distinct())
        seen = seen.unionByName(front)
    total = seen.groupBy("node").agg(F.sum("w").alias("n"))
    count = seen.join(own.select(F.col("node").alias("origin"), "target").distinct(), "origin").groupBy("node", "target").agg(F.sum("w").alias("c"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "target"))
    share = F.col("c") / F.col("n")
    shared = count.join(total.filter("n > 0"), "node").withColumn("rank", rank).filter((F.col("rank") <= top) & (share >= MIN_SHARE))
    shared = shared.select("node", "target", F.round(F.lit(GEM_APPROX) * (0.5 + 0.5 * share), 3).alias("confidence"))
    plain = nodes.filter(~F.coalesce("concept_class", F.lit("")).isin("chapter", "block")).select("node").join(mapped, "node", "left_anti")
    bare = plain.join(total.filter("n > 0"), "node", "left_anti")
    kin = parents.join(mapped, "node").join(nodes.filter(title.contains("unspecified")).select("node"), "node").join(own, "node").select("parent", "target").distinct()
    lent = bare.join(parents, "node").join(kin, "parent").select("node", "target", F.lit(SIBLING).alias("confidence")).distinct()
    return shared.join(plain, "node", "left_semi").unionByName(lent)
