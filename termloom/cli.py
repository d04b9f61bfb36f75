"""Commands: init and load of a store, lookup, codes, annotate, evaluate, link, extract.

``--tables`` is a folder of Parquet tables, ``--store`` one that ``init`` and ``load`` write, version by version.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import annotate, extract, linking, lookup
from termloom.session import cut, table
from termloom.sources import atoms, codes, files, load, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom")
    p.add_argument("--tables", help="folder of Parquet tables")
    p.add_argument("--store", help="folder of a store")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("init")
    s = sub.add_parser("load")
    s.add_argument("kind", choices=["icd10cm", "icd9cm", "umls", "fees", "units", "codes"])
    s.add_argument("paths", nargs="+")
    for name in ("--payer", "--vocabulary", "--maps-to", "--effective"):
        s.add_argument(name)
    s.add_argument("--year", type=int)
    for verb in ("lookup", "codes", "annotate"):
        s = sub.add_parser(verb)
        s.add_argument("text", nargs="*")
        s.add_argument("--to", default="ICD10CM", help="vocabulary of the codes")
        s.add_argument("--limit", type=int, default=10)
        s.add_argument("--file", help="read the text from a file; - for standard input")
        s.add_argument("--json", action="store_true")
    s = sub.add_parser("evaluate")
    s.add_argument("terms", help="CSV of term, expected")
    s.add_argument("--to", default="ICD10CM")
    s.add_argument("--top", type=int, default=3)
    sub.add_parser("link").add_argument("--out", required=True)
    s = sub.add_parser("extract")
    s.add_argument("words", help="Parquet of doc_id, page, top, x0, x1, text")
    s.add_argument("--profile", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--pages")
    s.add_argument("--report")
    s.add_argument("--compare", help="CSV with a column code")
    return p


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV file with the number of their line, the header being line 1."""
    rows = files.strict_csv(spark, path)
    return rows.rdd.zipWithIndex().map(lambda x: (x[1] + 2, *x[0])).toDF("line int, " + ", ".join(f"`{c}` string" for c in rows.columns))


def _load(spark: SparkSession, a: argparse.Namespace) -> dict:
    store = load.Store.read(spark, a.store) if load.Store.exists(spark, a.store) else load.Store.empty(spark)
    if a.kind == "icd10cm":
        found = cut(files.find(spark, a.paths, {"order": r"order.*\.txt$", "tabular": r"tabular.*\.xml$", "index": r"index.*\.xml$"}))
        have = {r["kind"]: r["name"] for r in found.select("kind", "name").collect()}  # three rows
        if "order" not in have:
            raise FileNotFoundError("no order file")
        named = "".join(c if c.isdigit() else " " for c in have["order"]).split()
        year = a.year or next(int(n) for n in named if len(n) == 4)
        kind = lambda k: found.filter(F.col("kind") == k)
        store, stats = load.icd10(store, codes.order_file(files.lines(kind("order"))), codes.tabular(kind("tabular")) if "tabular" in have else None, codes.index_terms(kind("index")) if "index" in have else None, year)
    elif a.kind == "icd9cm":
        found = cut(files.find(spark, a.paths, {"dx": r"DESC_LONG_DX.*\.txt$", "sg": r"DESC_LONG_SG.*\.txt$", "forward": r"I9gem.*\.txt$", "backward": r"I10gem.*\.txt$"}))
        text = lambda k: files.lines(found.filter(F.col("kind") == k))
        walk = codes.crosswalk(text("forward")).unionByName(codes.crosswalk(text("backward"), True))
        store, stats = load.icd9(store, codes.descriptions(text("dx"))[0], codes.descriptions(text("sg"), True)[0], walk)
    elif a.kind == "umls":
        rows, types = atoms.read(spark, [p for p in a.paths if "CONSO" in p], atoms.ATOM_COLUMNS), atoms.read(spark, [p for p in a.paths if "STY" in p], atoms.TYPE_COLUMNS)
        version = spark.range(1).select(atoms.version(F.lit(a.paths[0])).alias("v")).first()["v"]
        store, stats = load.umls(store, rows, types, dt.date.today(), version)
    elif a.kind == "fees":
        store, stats = load.fees(store, _numbered(spark, a.paths[0]), a.payer, a.vocabulary, dt.date.fromisoformat(a.effective) if a.effective else None)
    elif a.kind == "units":
        store, stats = load.unit_values(store, _numbered(spark, a.paths[0]), a.payer)
    else:
        store, stats = load.code_list(store, _numbered(spark, a.paths[0]), a.vocabulary, a.maps_to)
    store.write(a.store, f"v{time.time_ns()}")
    return stats


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    _, layout = extract.profile(Path(a.profile).read_text())
    words = spark.read.parquet(a.words)
    if a.pages:
        last = words.agg(F.max("page")).first()[0] or 0
        words = words.filter(F.col("page").isin(files.page_numbers(a.pages, last)))
    lines = cut(extract.words_to_lines(words))
    if isinstance(layout, extract.Bulletin):
        rows, left = extract.bulletins(lines, layout, X.printed_date)
        head = ["code", "description", "units", "amount", "effective_start", "action"]
    elif layout.columns:
        rows, _, left = extract.records(lines, layout)
        rows = rows.select("*", *[F.try_element_at("values", F.lit(c)).alias(c) for c in layout.columns]).drop("values")
        head = ["code", "description", *layout.columns, "modifier", "section", "heading"]
    else:
        rows, left = extract.code_list(lines, layout)
        head = ["code", "description"]
    rows = cut(rows)
    sinks.write_csv(rows, a.out, head)
    if a.report:
        Path(a.report).write_text(sinks.report(rows, left, files.strict_csv(spark, a.compare, ["code"]) if a.compare else None))


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "init":
        load.Store.empty(spark).write(a.store, f"v{time.time_ns()}")
        return 0
    if a.verb == "load":
        print(_load(spark, a))
        return 0
    if a.verb == "extract":
        _extract(spark, a)
        return 0
    if a.tables:
        t = lambda n: table(spark, a.tables, n)
        concept, synonym, edge = t("concept"), t("concept_synonym"), t("concept_relationship")
    else:
        store = load.Store.read(spark, a.store)
        concept, synonym, edge = store.concept, store.synonym, store.edge
    if a.verb == "link":
        linking.link(linking.Names(concept, synonym), edge).write.mode("overwrite").parquet(a.out)
        return 0
    if a.verb == "evaluate":
        wanted = files.commented_csv(spark, a.terms).select(F.col("term").alias("query"), "expected").filter("query <> ''")
        found = lookup.find_codes(wanted.select("query").distinct(), synonym, concept, edge, a.to)
        lookup.hit_rate(found, wanted, a.top).show()
        return 0
    text = " ".join(a.text) if a.text else sys.stdin.read() if a.file in (None, "-") else Path(a.file).read_text()
    q = spark.createDataFrame([(text,)], "query string")
    if a.verb == "lookup":
        out = lookup.find_terms(q, synonym, concept, a.limit)
    elif a.verb == "codes":
        out = lookup.find_codes(q, synonym, concept, edge, a.to, a.limit)
    else:
        docs = q.select(F.lit(1).cast("bigint").alias("doc_id"), F.col("query").alias("text"))
        linked = edge.filter(F.col("relationship_id").isin(lookup.HOPS)).select(F.col("concept_id_1").alias("concept_id"))
        terms = cut(annotate.dictionary(concept, synonym, linked))
        events = annotate.spotted(docs, terms, cues=True)
        found = annotate.with_context(annotate.mentions(docs, terms, events=events), docs, events)
        found = annotate.with_codes(found, lookup.concept_codes(concept, edge, ["ICD10CM", "ICD9CM", "NS_MSI"]))
        best = concept.select(F.col("concept_id").alias("c_"), F.concat_ws(":", F.lower("vocabulary_id"), "code").alias("key"), "name")
        out = found.join(best, F.col("candidates")[0]["concept_id"] == F.col("c_"), "left").select("start", "end", "text", "key", "name", "assertion", "experiencer", "temporality", "cues", "codes").orderBy("start")
    if a.json:
        for r in out.select(F.to_json(F.struct(*out.columns)).alias("j")).collect():  # what one text or term gives
            print(r["j"])
    else:
        out.show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
