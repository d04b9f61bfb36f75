"""Batch lookups: terms to concepts and to ranked codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as X

#: Relationships that lead from a concept to a code, and the confidence of links without one.
HOPS = ["umls_cui_of", "may_be", "maps_to", "maps_to_approx", "mapped_from", "approx_mapped_from"]


def confidence(c: str = "confidence", rel: str = "relationship_id") -> Column:
    return F.coalesce(F.col(c), F.when(F.col(rel).isin("maps_to", "mapped_from"), 0.8).when(F.col(rel).isin("maps_to_approx", "approx_mapped_from"), 0.7).otherwise(1.0))


def _matched(queries: DataFrame, synonym: DataFrame) -> DataFrame:
    """query, concept_id, term, exact: synonyms equal to the query or beginning with it and a blank.

    Prefixes are met by an equi-join on the query's words: a synonym offers each of its prefixes of whole words."""
    q = queries.select("query", X.normalize(F.col("query")).alias("norm")).filter("norm <> ''").distinct()
    s = synonym.filter(F.col("term").isNotNull()).select("concept_id", "term", "term_type", F.split(X.normalize(F.col("term")), " ").alias("ws")).distinct()
    lens = q.select(F.size(F.split("norm", " ")).alias("n")).distinct()
    longest = lens.agg(F.max("n")).first()[0] or 0  # one number
    p = s.select("concept_id", "term", "term_type", F.size("ws").alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("ws"), F.lit(max(1, longest)))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("ws", 1, k), " ").alias("norm")))).alias("p"))
    p = p.select("concept_id", "term", "term_type", F.col("p.norm").alias("norm"), (F.col("p.k") == F.col("len")).alias("exact"))
    return q.join(p, "norm").select("query", "concept_id", "term", "term_type", "exact")


def find_terms(queries: DataFrame, synonym: DataFrame, concept: DataFrame, limit: int = 20) -> DataFrame:
    """The best ``limit`` concepts of each query: exact terms first, then by term and id."""
    m = _matched(queries, synonym).join(concept.select("concept_id", "vocabulary_id", "code", "name"), "concept_id")
    m = m.groupBy("query", "concept_id", "vocabulary_id", "code", "name").agg(F.min(F.struct((~F.col("exact")).alias("far"), "term")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("b.far", "b.term", "concept_id"))
    return m.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "rank", "concept_id", "vocabulary_id", "code", "name", F.col("b.term").alias("term"), (~F.col("b.far")).alias("exact"))


def find_codes(queries: DataFrame, synonym: DataFrame, concept: DataFrame, edges: DataFrame, vocabulary: str, limit: int = 20, curated: DataFrame | None = None) -> DataFrame:
    """query, rank, code, name, confidence: the best codes of ``vocabulary`` for each query.

    Ranked by: curated (query, code, name, position) first, exact terms before prefixes, concepts named by the term,
    confidence (manifestations count half), billable codes, unspecified titles, code. One row per query and code; only
    the codes of one query meet in a window, after an aggregation to its distinct codes."""
    m = _matched(queries, synonym)
    c = concept.select("concept_id", F.col("name").alias("source_name"), F.col("vocabulary_id").alias("source_vocabulary"))
    t = concept.filter(F.col("vocabulary_id") == vocabulary).select(F.col("concept_id").alias("code_id"), "code", "name", "is_billable")
    m = m.join(c, "concept_id")
    hop = edges.filter(F.col("relationship_id").isin(HOPS)).select(F.col("concept_id_1").alias("concept_id"), F.col("concept_id_2").alias("code_id"), confidence().alias("confidence"))
    via = m.join(hop, "concept_id").select("query", "code_id", "term", "exact", "source_name", "confidence")
    own = m.filter(F.col("source_vocabulary") == vocabulary).select("query", F.col("concept_id").alias("code_id"), "term", "exact", "source_name", F.lit(1.0).alias("confidence"))
    r = via.unionByName(own).join(t, "code_id")
    conf = F.col("confidence") * F.when(F.col("name").rlike(X.MANIFESTATION), 0.5).otherwise(1.0)
    r = r.withColumn("confidence", conf)
    a, b = X.word_set(F.col("source_name"))["key"], X.word_set(F.col("term"))["key"]
    rank = F.struct((~F.col("exact")).alias("far"), (~F.coalesce(a == b, F.lit(False))).alias("aside"), (-F.col("confidence")).alias("less"), (~F.coalesce("is_billable", F.lit(False))).alias("open"),
                    (~F.lower("name").contains("unspecified")).alias("special"))
    best = r.groupBy("query", "code", "name").agg(F.min(rank).alias("r"))
    best = best.select("query", "code", "name", F.lit(1).alias("tier"), F.lit(0).alias("position"), "r", (-F.col("r.less")).alias("confidence"))
    if curated is not None:
        kept = curated.select("query", "code", "name", F.lit(0).alias("tier"), "position", F.lit(None).cast(best.schema["r"].dataType).alias("r"), F.lit(1.0).alias("confidence"))
        best = best.join(curated.select("query", "code").distinct(), ["query", "code"], "left_anti").unionByName(kept)
    order = Window.partitionBy("query").orderBy("tier", "position", "r", "code")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "rank", "code", "name", F.round("confidence", 6).alias("confidence"))


def concept_codes(concept: DataFrame, edges: DataFrame, vocabularies: list[str], per_vocabulary: int = 3, least: float = 0.4) -> DataFrame:
    """concept_id, vocabulary_id, rank, code, name, confidence: each concept's own code and its linked ones, the best per vocabulary."""
    codes = concept.filter(F.col("vocabulary_id").isin(vocabularies))
    own = codes.select("concept_id", F.col("concept_id").alias("code_id"), "vocabulary_id", "code", "name", "is_billable", F.when(F.col("name").rlike(X.MANIFESTATION), 0.5).otherwise(1.0).alias("confidence"))
    t = codes.filter(~F.coalesce("concept_class", F.lit("")).isin("chapter", "block")).select(F.col("concept_id").alias("code_id"), "vocabulary_id", "code", "name", "is_billable")
    via = edges.filter(F.col("relationship_id").isin(HOPS)).select(F.col("concept_id_1").alias("concept_id"), F.col("concept_id_2").alias("code_id"), confidence().alias("confidence")).join(t, "code_id")
    best = own.unionByName(via).groupBy("concept_id", "vocabulary_id", "code", "name", F.coalesce("is_billable", F.lit(False)).alias("billable")).agg(F.round(F.max("confidence"), 3).alias("confidence"))
    order = Window.partitionBy("concept_id", "vocabulary_id").orderBy(F.desc(F.round(F.col("confidence") - F.when(F.col("billable"), 0.0).otherwise(0.1), 6)), ~F.lower("name").contains("unspecified"), "code")
    return best.filter(F.col("confidence") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_vocabulary).drop("billable")


def hit_rate(found: DataFrame, expected: DataFrame, top: int = 3) -> DataFrame:
    """expected: query, expected (code prefixes joined by |, * for any). Gives expected, reached and hits in the top."""
    per = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("rank") <= top, F.col("code"))).alias("codes"))
    e = expected.filter(F.coalesce(F.trim("expected"), F.lit("")) != "").join(per, "query", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    reached = F.coalesce(F.col("n") > 0, F.lit(False))
    hit = F.when(F.trim("expected") == "*", reached).otherwise(F.exists("codes", lambda c: F.exists(F.split("expected", r"\|"), lambda p: c.startswith(F.trim(p)))))
    return e.agg(F.count(F.lit(1)).alias("n_expected"), F.coalesce(F.sum(reached.cast("bigint")), F.lit(0)).alias("n_reached"), F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("n_hits"))


def nearest_prefix(codes: DataFrame, shortest: int = 3) -> DataFrame:
    """code, parent: the longest shorter code of ``codes`` that begins it, of at least ``shortest`` characters."""
    c = codes.select("code").filter("code is not null").distinct()
    cut = c.filter(F.length("code") > shortest).select("code", F.explode(F.sequence(F.lit(shortest), F.length("code") - 1)).alias("n"))
    return cut.withColumn("parent", F.expr("substring(code, 1, n)")).join(c.select(F.col("code").alias("parent")), "parent").groupBy("code").agg(F.max_by("parent", "n").alias("parent"))


def longest_prefix(codes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """code, prefix: the longest of ``prefixes`` that begins each code; codes without one give no row, null and empty ones count not."""
    c = codes.select("code").filter("code <> ''").distinct()
    cut = c.select("code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n))).alias("prefix"))
    return cut.join(prefixes.select("prefix").filter("prefix <> ''").distinct(), "prefix").groupBy("code").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def resolve_printed(printed: DataFrame, codes: DataFrame, shortest: int = 3) -> DataFrame:
    """printed, code: the longest beginning of a printed code that is a code, trailing dashes and dots aside."""
    p = printed.select("printed").filter("printed is not null").distinct().withColumn("bare", F.regexp_replace("printed", r"[-.\s]+$", ""))
    cut = p.filter(F.length("bare") >= shortest).withColumn("n", F.explode(F.sequence(F.lit(shortest), F.length("bare")))).withColumn("code", F.regexp_replace(F.expr("substring(bare, 1, n)"), r"[-.]+$", ""))
    return cut.join(codes.select("code").distinct(), "code").groupBy("printed").agg(F.max_by("code", "n").alias("code"))
