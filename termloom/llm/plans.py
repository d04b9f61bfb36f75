"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import abuse, leakage, mixing, truncation
from termloom.session import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    one = lambda tbl, key, source, text: table(spark, d, tbl).select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return one("concept_synonym", "synonym_id", "source", "term").unionByName(one("ns_msi_sample", "fee_row_id", "feed", "description"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concept").select(F.lit("concept").alias("tbl"), F.col("name").alias("text")).unionByName(
        table(spark, d, "concept_snapshot").select(F.lit("concept").alias("tbl"), F.col("name").alias("text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(_terms(spark, d), _copies(spark, d)).select("tbl", "row_id").distinct()


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """The part of p4_found that a longer copy of the whole value settles."""
    return truncation.found(_terms(spark, d), _copies(spark, d)).filter("by = 'copy'").select("tbl", "row_id").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = _terms(spark, d)
    return truncation.rates(truncation.found(rows, _copies(spark, d)), rows)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "annotate_sentences"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.spans(table(spark, d, "documents"), table(spark, d, "annotate_sentences"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.scores(docs, abuse.train(abuse.labelled_rows(docs, table(spark, d, "review_label"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_copies, p4_rates, p8_found, p8_spans, p9_mixture, p9_report, p10_found, p10_scores, p10_rates)}
_WORD = truncation.WORD.replace("'", "''")
_MARKS = "(\\.\\.\\.|…|\ufffd)\\s*$"
_P4 = f"""with r as (select 'concept_synonym' tbl, synonym_id row_id, term as txt from concept_synonym union all select 'ns_msi_sample', fee_row_id, description from ns_msi_sample),
    a as (select tbl, txt from r union all select 'concept', name from concept union all select 'concept', name from concept_snapshot),
    v as (select distinct lower(rtrim(regexp_replace(txt, '{_MARKS}', ''))) fold, bool_and(regexp_matches(txt, '{_MARKS}')) marked from a where txt is not null group by tbl, lower(rtrim(regexp_replace(txt, '{_MARKS}', '')))),
    t as materialized (select fold, marked, regexp_extract_all(fold, '{_WORD}[^\\p{{L}}\\p{{N}}%$¢]*') t from v),
    w as (select fold, marked, t, unnest(range(1, len(t) + 1)) i from t),
    e as materialized (select fold, marked, array_to_string(t[:i - 1], '') head, regexp_extract(t[i], '^{_WORD}') word, i = len(t) last, len(t) n, t[i] tok from w),
    inner_words as (select distinct word from e where not last and not marked),
    ends as (select distinct fold, head, word, n, tok from e where last and word not in (select word from inner_words)),
    hit as (select distinct x.fold, x.n, x.tok from ends x join (select distinct head, word from e where not marked) y on y.head = x.head and starts_with(y.word, x.word) and length(y.word) > length(x.word)
        where regexp_matches(y.word[length(x.word) + 1:], '^[\\p{{L}}\\p{{N}}]') and y.word[length(x.word) + 1:] not in ('s', 'es'))
    select distinct tbl, row_id from r join hit on hit.fold = lower(rtrim(regexp_replace(txt, '{_MARKS}', ''))) where txt is not null and not regexp_matches(tok, '[)\\].\"!?]')
    and not (n = 1 and regexp_matches(rtrim(regexp_replace(txt, '{_MARKS}', '')), '^[^\\p{{Ll}}\\s]{{1,10}}$') and not regexp_matches(txt, '{_MARKS}'))"""
SQL: dict[str, str] = {"p4_copies": _P4}
