"""Loading releases, fee lists and code lists into the tables, as rewrites of whole tables.

A ``Store`` is a set of tables; each load takes one and gives a new one with counts. Every row carries the source that
brought it, and a load replaces the rows of its own source only. Links are kept in both directions.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import tables as T
from termloom.sources import atoms as A
from termloom.sources import codes as C
from termloom.session import cut

CONCEPT = "concept_id bigint, vocabulary_id string, code string, name string, domain string, concept_class string, is_billable boolean, valid_start date, valid_end date"
SYNONYM = "concept_id bigint, term string, term_normalized string, term_type string, language string, source string"
EDGE = "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, map_priority int, confidence double, source string"
FEE = ("payer_id string, concept_id bigint, section string, modifier string, locality string, effective_start date, effective_end date, category string, heading string, description string, "
       "units decimal(10,2), amount decimal(10,2), anaesthesia_units decimal(10,2), fee_note string")
UNIT_VALUE = "payer_id string, unit_name string, effective_start date, effective_end date, amount_per_unit decimal(10,4)"
VOCABULARY = "vocabulary_id string, version string"
LONGEST, LONGEST_NOTE = 1000, 255
REVERSE = {"is_a": "subsumes", "maps_to": "mapped_from", "maps_to_approx": "approx_mapped_from", "has_umls_cui": "umls_cui_of"}
FEE_KEY = ["payer_id", "concept_id", "section", "modifier", "locality", "effective_start"]


@dataclass
class Store:
    """The tables of a terminology and its fees."""

    concept: DataFrame
    synonym: DataFrame
    edge: DataFrame
    fee: DataFrame
    unit_value: DataFrame
    vocabulary: DataFrame

    NAMES = ("concept", "synonym", "edge", "fee", "unit_value", "vocabulary")

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(*[spark.createDataFrame([], s) for s in (CONCEPT, SYNONYM, EDGE, FEE, UNIT_VALUE, VOCABULARY)])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Store:
        """The newest complete version under ``path``."""
        newest = spark.read.text(f"{path}/current").first()[0]
        return cls(*[spark.read.parquet(f"{path}/{newest}/{n}") for n in cls.NAMES])

    def write(self, path: str, version: str) -> None:
        """All tables into a folder of their own, then the pointer to it: readers see the old version or the new one whole."""
        spark = self.concept.sparkSession
        for n in self.NAMES:
            getattr(self, n).write.mode("overwrite").parquet(f"{path}/{version}/{n}")
        spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/current")

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def cut(self) -> Store:
        return Store(*[cut(getattr(self, n)) for n in self.NAMES])


def _ids(store: Store, rows: DataFrame) -> DataFrame:
    """rows(vocabulary_id, code, ...) with the concept_id of each, new ones in order of vocabulary and code."""
    known = store.concept.select("vocabulary_id", "code", "concept_id")
    mine = T.assign_ids(known, rows.select("vocabulary_id", "code"), ["vocabulary_id", "code"], "concept_id")
    return rows.join(mine, ["vocabulary_id", "code"])


def _put(store: Store, rows: DataFrame, update: list[str], revive: bool = True) -> tuple[Store, DataFrame]:
    """Rows(vocabulary_id, code, name, ...) put into concept; also gives them with ids."""
    with_ids = cut(_ids(store, rows.withColumn("name", F.substring("name", 1, LONGEST))))
    new = T.upsert(store.concept, with_ids, ["vocabulary_id", "code"], update, ("valid_end",) if revive else ())
    return replace(store, concept=cut(new)), with_ids


def _synonyms(store: Store, rows: DataFrame, mine: Column) -> Store:
    """Rows(concept_id, term, term_type, source), each key once, in place of those that ``mine`` tells; null, empty and too long terms are left out."""
    norm = X.normalize(F.col("term"))
    rows = rows.filter(F.length("term") <= LONGEST).select("concept_id", "term", norm.alias("term_normalized"), "term_type", F.lit("en").alias("language"), "source").filter("term_normalized <> ''")
    rows = T.first_wins(rows, ["concept_id", "term_normalized", "term_type"], ["term", "source"]).select(store.synonym.columns)
    kept = T.refresh_source(store.synonym, rows.limit(0), mine)
    return replace(store, synonym=cut(T.insert_absent(kept, rows, ["concept_id", "term_normalized", "term_type"])))


def _edges(store: Store, rows: DataFrame, mine: Column) -> Store:
    """Rows(concept_id_1, concept_id_2, relationship_id, map_priority, confidence, source) and their reverses, in place of those that ``mine`` tells."""
    cols = store.edge.columns
    rows = rows.select(cols)
    back = rows.select(F.col("concept_id_2").alias("concept_id_1"), F.col("concept_id_1").alias("concept_id_2"),
                       F.try_element_at(F.create_map(*[F.lit(x) for kv in REVERSE.items() for x in kv]), F.col("relationship_id")).alias("relationship_id"), "map_priority", "confidence", "source")
    both = T.first_wins(rows.unionByName(back), cols[:3], ["source", "map_priority"]).select(cols)
    kept = T.refresh_source(store.edge, both.limit(0), mine)
    return replace(store, edge=cut(T.upsert(kept, both, cols[:3], ["map_priority", "confidence", "source"])))


def stamp(store: Store, vocabulary: str, version: str) -> Store:
    """The version of a vocabulary, added or replaced."""
    new = store.concept.sparkSession.createDataFrame([(vocabulary, version)], VOCABULARY)
    return replace(store, vocabulary=cut(T.upsert(store.vocabulary, new, ["vocabulary_id"], ["version"])))


def icd10(store: Store, order: DataFrame | None, tabular: DataFrame | None = None, index: DataFrame | None = None, year: int = 0) -> tuple[Store, dict]:
    """A release of ICD-10-CM of fiscal ``year``: ``codes.order_file`` (needed), ``codes.tabular``, ``codes.index_terms``.

    New codes start on 1 October before the year; codes that are missing end the day before, but chapters and blocks only
    if the release has a tabular list. Codes that come back are valid again."""
    if order is None:
        raise FileNotFoundError("a release needs its order file")
    start = dt.date(year - 1, 10, 1)
    rows = order.select("code", "name", "domain", "concept_class", "is_billable", F.lit(0).alias("by"))
    if tabular is not None:
        tabular = cut(tabular)
        heads = tabular.filter("row in ('chapter', 'block')").select("code", F.col("text").alias("name"), F.lit("condition").alias("domain"), F.col("row").alias("concept_class"), F.lit(False).alias("is_billable"), F.lit(1).alias("by"))
        rows = rows.unionByName(heads)
    rows = T.first_wins(rows, ["code"], ["by"]).drop("by").withColumn("vocabulary_id", F.lit("ICD10CM")).withColumn("valid_start", F.lit(start))
    before = store.concept.filter("vocabulary_id = 'ICD10CM'")
    store, ids = _put(store, rows, ["name", "domain", "concept_class", "is_billable"])
    may_end = (F.col("vocabulary_id") == "ICD10CM") & (F.lit(tabular is not None) | ~F.coalesce("concept_class", F.lit("")).isin("chapter", "block"))
    mine = T.retire(store.concept.filter(may_end), ids.select("concept_id"), ["concept_id"], F.lit(start - dt.timedelta(days=1)))
    store = replace(store, concept=cut(store.concept.filter(~F.coalesce(may_end, F.lit(False))).unionByName(mine)))
    key = ids.select("code", "concept_id")
    up = C.parents_by_prefix(order).select("code", "parent")
    if tabular is not None:
        up = up.unionByName(tabular.filter("row = 'link'").select("code", "parent"))
    known = key.select(F.col("code").alias("parent"), F.col("concept_id").alias("concept_id_2"))
    links = up.join(key, "code").join(known, "parent").select(F.col("concept_id").alias("concept_id_1"), "concept_id_2", F.lit("is_a").alias("relationship_id"), F.lit(None).cast("int").alias("map_priority"), F.lit(None).cast("double").alias("confidence"), F.lit("ICD10CM").alias("source")).distinct()
    store = _edges(store, links, F.col("source") == "ICD10CM")
    terms = ids.select("concept_id", F.col("name").alias("term"), F.lit("preferred").alias("term_type"))
    if tabular is not None:
        terms = terms.unionByName(tabular.filter("row = 'term'").join(key, "code").select("concept_id", F.col("text").alias("term"), F.lit("clinical").alias("term_type")))
    if index is not None:
        shown = index.withColumn("printed", F.col("code"))
        real = _resolved(shown.select("printed"), key.select("code"))
        terms = terms.unionByName(shown.select("printed", "term").join(real, "printed").join(key, "code").select("concept_id", "term", F.lit("index").alias("term_type")))
    store = stamp(_synonyms(store, terms.withColumn("source", F.lit("ICD10CM")), F.col("source") == "ICD10CM"), "ICD10CM", str(year))
    ended = before.select("concept_id").join(ids.select("concept_id"), "concept_id", "left_anti").count()
    return store, {"codes": ids.count(), "billable": ids.filter("is_billable").count(), "new": ids.join(before.select("concept_id"), "concept_id", "left_anti").count(), "missing": ended,
                   "links": links.count(), "synonyms": store.synonym.filter("source = 'ICD10CM'").count()}


def _resolved(printed: DataFrame, codes: DataFrame) -> DataFrame:
    from termloom.operators.lookup import resolve_printed

    return resolve_printed(printed, codes)


def icd9(store: Store, diagnoses: DataFrame, procedures: DataFrame | None = None, crosswalk: DataFrame | None = None) -> tuple[Store, dict]:
    """ICD-9-CM from ``codes.descriptions`` and its crosswalk from ``codes.crosswalk``. Codes are neither retired nor revived."""
    rows = diagnoses.select("code", "name", F.lit(False).alias("proc"))
    if procedures is not None:
        rows = rows.unionByName(procedures.select("code", "name", F.lit(True).alias("proc")))
    rows = T.first_wins(rows, ["code"], ["proc"]).select("code", "name", X.icd9_domain(F.col("code"), F.col("proc")).alias("domain"), F.when(F.col("proc"), "procedure").otherwise("code").alias("concept_class"),
                                                          F.lit(True).alias("is_billable"), F.lit("ICD9CM").alias("vocabulary_id"), F.lit(None).cast("date").alias("valid_start"))
    store, ids = _put(store, rows, ["name", "domain"], revive=False)
    store = _synonyms(store, ids.select("concept_id", F.col("name").alias("term"), F.lit("preferred").alias("term_type"), F.lit("ICD9CM").alias("source")), F.col("source") == "ICD9CM")
    stats = {"codes": ids.count(), "maps_to": 0, "maps_to_approx": 0, "no_map": 0, "not_loaded": 0}
    if crosswalk is not None:
        at = lambda v, a, b: store.concept.filter(F.col("vocabulary_id") == v).select(F.col("code").alias(a), F.col("concept_id").alias(b))
        x = cut(crosswalk.join(at("ICD9CM", "icd9", "concept_id_1"), "icd9", "left").join(at("ICD10CM", "icd10", "concept_id_2"), "icd10", "left"))
        good = x.filter("not no_map and concept_id_1 is not null and concept_id_2 is not null")
        links = T.first_wins(good.select("concept_id_1", "concept_id_2", F.col("relationship").alias("relationship_id"), F.col("priority").alias("map_priority")), ["concept_id_1", "concept_id_2", "relationship_id"], ["map_priority"])
        store = _edges(store, links.withColumn("confidence", F.lit(None).cast("double")).withColumn("source", F.lit("CMS_GEM")), F.col("source") == "CMS_GEM")
        n = {r["relationship_id"]: r["n"] for r in links.groupBy("relationship_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        stats |= {**n, "no_map": x.filter("no_map").count(), "not_loaded": x.filter("not no_map and (concept_id_1 is null or concept_id_2 is null)").count()}
    return store, stats


def umls(store: Store, atom_rows: DataFrame, types: DataFrame, today: dt.date, version: str = "unknown", sources: list[str] | None = None) -> tuple[Store, dict]:
    """A pipe-delimited release: its concepts, their terms, and links to the codes of vocabularies that are loaded or come
    with it. Concepts that are missing end on ``today``; links made by matching stay."""
    kept = cut(A.in_domain(A.wanted(atom_rows, sources), A.domains(types)))
    domain = kept.groupBy("CUI").agg(F.min("domain").alias("domain"))
    rows = A.concepts(kept).join(domain, "CUI").select(F.col("CUI").alias("code"), "name", "domain", F.lit("UMLS").alias("vocabulary_id"), F.lit(None).cast("string").alias("concept_class"), F.lit(None).cast("boolean").alias("is_billable"), F.lit(None).cast("date").alias("valid_start"))
    store, ids = _put(store, rows, ["name", "domain"])
    mine = F.col("vocabulary_id") == "UMLS"
    ended = T.retire(store.concept.filter(mine), ids.select("concept_id"), ["concept_id"], F.lit(today))
    store = replace(store, concept=cut(store.concept.filter(~mine).unionByName(ended)))
    own = A.source_codes(kept).select(F.col("SAB").alias("vocabulary_id"), "code", "name")
    fresh = own.join(store.concept.select("vocabulary_id", "code"), ["vocabulary_id", "code"], "left_anti").withColumn("domain", F.lit("other"))
    store, _ = _put(store, fresh.withColumn("concept_class", F.lit(None).cast("string")).withColumn("is_billable", F.lit(None).cast("boolean")).withColumn("valid_start", F.lit(None).cast("date")), [], revive=False)
    key = ids.select(F.col("code").alias("CUI"), "concept_id")
    store = _synonyms(store, A.synonyms(kept).join(key, "CUI").select("concept_id", "term", "term_type", "source"), F.col("source").startswith("UMLS/"))
    codes = store.concept.select(F.col("vocabulary_id").alias("SAB"), "code", F.col("concept_id").alias("code_id"))
    links = A.code_links(kept).join(key, "CUI").join(codes, ["SAB", "code"]).select(F.col("code_id").alias("concept_id_1"), F.col("concept_id").alias("concept_id_2"), F.lit("has_umls_cui").alias("relationship_id"),
                                                                                     F.lit(None).cast("int").alias("map_priority"), F.lit(None).cast("double").alias("confidence"), F.lit("UMLS").alias("source"))
    store = stamp(_edges(store, links, F.col("source") == "UMLS"), "UMLS", version)
    return store, {"concepts": ids.count(), "synonyms": store.synonym.filter("source like 'UMLS/%'").count(), "links": links.distinct().count(), "retired": store.concept.filter(mine & (F.col("valid_end") == F.lit(today))).count()}


# -- checked rows of lists ---------------------------------------------------------------


def checked(rows: DataFrame, dates: list[str], numbers: list[str], scale: int = 2) -> DataFrame:
    """Rows(line, ...) with dates (ISO) and numbers (without $ and commas) read; empty ones are null. ``error`` names the
    line and column of the first value that cannot be read, and is null where all can."""
    have = set(rows.columns)
    error = F.lit(None).cast("string")
    for c in [*dates, *numbers]:
        raw = F.nullif(F.trim(F.col(c)), F.lit("")) if c in have else F.lit(None).cast("string")
        if c in dates:
            value = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
        else:
            value = F.regexp_replace(raw, r"[$,\s]", "").try_cast(f"decimal(10,{scale})")
        error = F.coalesce(error, F.when(raw.isNotNull() & value.isNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(f": bad {c} "), raw)))
        rows = rows.withColumn(f"_{c}", value)
    rows = rows.withColumn("error", error)
    for c in [*dates, *numbers]:
        rows = rows.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return rows


def _fail(rows: DataFrame) -> None:
    """Raises for the first row with an error."""
    bad = rows.filter("error is not null").agg(F.min(F.struct("line", "error")).alias("e")).first()["e"]
    if bad:
        raise ValueError(bad["error"])


def _text(rows: DataFrame, *names: str) -> DataFrame:
    for c in names:
        rows = rows.withColumn(c, F.coalesce(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(""))
    return rows


def fees(store: Store, rows: DataFrame, payer: str, vocabulary: str, effective: dt.date | None = None) -> tuple[Store, dict]:
    """Fees of a payer from rows(line, code, description, and what FEE names, as text).

    Every row with a code votes for its name: the most common description, any before none, the earliest on ties. The
    first row of a key counts; later ones that differ are conflicts. A list with a column ``action`` is a change log: it
    adds dated fees and new codes, renames nothing, and ends codes that are terminated unless they have a later fee."""
    log = "action" in rows.columns
    rows = _text(rows, "code", "description", "section", "modifier", "locality", "category", "heading", "fee_note", "action").filter("code <> ''")
    values = ["units", "amount", "anaesthesia_units"]
    rows = checked(rows, ["effective_start", "effective_end"], values)
    rows = rows.withColumn("effective_start", F.coalesce("effective_start", F.lit(effective).cast("date")))
    gone = F.col("action") == "terminated"
    empty = ~gone & F.coalesce(*[F.col(c).cast("string") for c in values]).isNull() & (F.col("fee_note") == "")
    line = F.concat(F.lit("line "), F.col("line").cast("string"))
    rows = cut(rows.withColumn("error", F.coalesce("error", F.when(F.col("effective_start").isNull(), F.concat(line, F.lit(": no effective_start"))), F.when(empty, F.concat(line, F.lit(": no value"))))))
    _fail(rows)
    names = T.mode(rows.select("code", "description", "line"), ["code"], "description", "line").select("code", F.col("description").alias("name"))
    new = names.select("code", "name", F.lit(vocabulary).alias("vocabulary_id"), F.lit("procedure").alias("domain"), F.lit("fee_code").alias("concept_class"), F.lit(True).alias("is_billable"), F.lit(None).cast("date").alias("valid_start"))
    before = store.concept.filter(F.col("vocabulary_id") == vocabulary).select("code").withColumn("old", F.lit(True))
    store, ids = _put(store, new, [] if log else ["name"], revive=not log)
    key = cut(ids.select("code", "concept_id", "name").join(before, "code", "left"))
    source = f"{payer}_{'BULLETINS' if log else 'FEES'}"
    first = F.when(F.col("old") & F.lit(log), "clinical").otherwise("preferred")
    terms = key.select("concept_id", F.col("name").alias("term"), first.alias("term_type"))
    other = rows.select("code", "description").distinct().join(key, "code").filter(X.normalize(F.col("description")) != X.normalize(F.col("name")))
    terms = terms.unionByName(other.select("concept_id", F.col("description").alias("term"), F.lit("clinical").alias("term_type")))
    store = _synonyms(store, terms.withColumn("source", F.lit(source)), F.col("source") == source)
    priced = rows.filter(~gone).join(key.select("code", "concept_id"), "code").withColumn("payer_id", F.lit(payer))
    judged = T.conflicts(priced.select(*FEE_KEY, *values, "fee_note", "line"), FEE_KEY, [*values, "fee_note"], ["line"])
    none = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit("")).alias(c)
    one = T.first_wins(priced.select(*FEE_KEY, "effective_end", none("category", LONGEST), none("heading", LONGEST), none("description", LONGEST), *values, none("fee_note", LONGEST_NOTE), "line"), FEE_KEY, ["line"])
    one = cut(one.select(store.fee.columns))
    store = replace(store, fee=cut(T.upsert(store.fee, one, FEE_KEY, [c for c in store.fee.columns if c not in FEE_KEY])))
    ended = rows.filter(gone).join(key.select("code", "concept_id"), "code").groupBy("concept_id").agg(F.max("effective_start").alias("day"))
    later = store.fee.groupBy("concept_id").agg(F.max("effective_start").alias("day"))
    over = T.terminate(ended, later, "concept_id").withColumnRenamed("day", "_end").withColumnRenamed("concept_id", "_id")
    c = store.concept.join(over, F.col("concept_id") == F.col("_id"), "left").withColumn("valid_end", F.coalesce("_end", "valid_end")).drop("_end", "_id")
    store = replace(store, concept=cut(c))
    return store, {"codes": key.count(), "fees": one.count(), "conflicts": judged.agg(F.coalesce(F.sum("n_conflicts"), F.lit(0))).first()[0], "terminated": ended.count()}


def unit_values(store: Store, rows: DataFrame, payer: str) -> tuple[Store, dict]:
    """What a payer's units are worth, from rows(line, unit_name, effective_start, effective_end, amount_per_unit as text)."""
    rows = checked(_text(rows, "unit_name"), ["effective_start", "effective_end"], ["amount_per_unit"], scale=4)
    bare = F.col("effective_start").isNull() | F.col("amount_per_unit").isNull()
    rows = cut(rows.withColumn("error", F.coalesce("error", F.when(bare, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": effective_start and amount_per_unit are needed"))))))
    _fail(rows)
    key = ["payer_id", "unit_name", "effective_start"]
    new = cut(T.last_wins(rows.withColumn("payer_id", F.lit(payer)).select(*store.unit_value.columns, "line"), key, ["line"]).select(store.unit_value.columns))
    return replace(store, unit_value=cut(T.upsert(store.unit_value, new, key, ["effective_end", "amount_per_unit"]))), {"unit_values": new.count()}


def code_list(store: Store, rows: DataFrame, vocabulary: str, maps_to: str | None = None, domain: str = "condition") -> tuple[Store, dict]:
    """A plain list of rows(line, code, description, maps_to), with approximate links to the codes of another vocabulary."""
    rows = cut(_text(rows, "code", "description", "maps_to"))
    last = T.last_wins(rows.filter("code <> ''").select("code", "description", "line"), ["code"], ["line"])
    new = last.select("code", F.col("description").alias("name"), F.lit(vocabulary).alias("vocabulary_id"), F.lit(domain).alias("domain"), F.lit("code").alias("concept_class"), F.lit(True).alias("is_billable"), F.lit(None).cast("date").alias("valid_start"))
    store, ids = _put(store, new, ["name"])
    source = f"{vocabulary}_LIST"
    store = _synonyms(store, ids.select("concept_id", F.col("name").alias("term"), F.lit("preferred").alias("term_type"), F.lit(source).alias("source")), F.col("source") == source)
    stats = {"codes": ids.count(), "maps_to": 0, "target_not_loaded": 0}
    if maps_to:
        to = store.concept.filter(F.col("vocabulary_id") == maps_to).select(F.col("code").alias("maps_to"), F.col("concept_id").alias("concept_id_2"))
        x = cut(rows.filter("maps_to <> ''").join(to, "maps_to", "left").join(ids.select("code", F.col("concept_id").alias("concept_id_1")), "code", "left"))
        links = x.filter("concept_id_1 is not null and concept_id_2 is not null").select("concept_id_1", "concept_id_2").distinct()
        links = cut(links.select("*", F.lit("maps_to_approx").alias("relationship_id"), F.lit(None).cast("int").alias("map_priority"), F.lit(None).cast("double").alias("confidence"), F.lit(source).alias("source")))
        store = _edges(store, links, F.col("source") == source)
        stats |= {"maps_to": links.count(), "target_not_loaded": x.filter("concept_id_2 is null").count()}
    return store, stats


def priced(store: Store, day: Column, units: dict[str, str]) -> DataFrame:
    """Fees in force on ``day`` with the value of their unit then: the last start at or before it that has not ended.

    units: fee column -> unit name (units -> MSU, say); gives a column ``<fee column>_rate`` for each."""
    live = lambda df: df.filter((F.col("effective_start") <= day) & (F.col("effective_end").isNull() | (F.col("effective_end") >= day)))
    key = ["payer_id", "concept_id", "section", "modifier", "locality"]
    out = T.last_wins(live(store.fee), key, ["effective_start"])
    for column, unit in units.items():
        rate = T.last_wins(live(store.unit_value.filter(F.col("unit_name") == unit)).select("payer_id", "effective_start", F.col("amount_per_unit").alias(f"{column}_rate")), ["payer_id"], ["effective_start"])
        out = out.join(rate.drop("effective_start"), "payer_id", "left")
    return out
