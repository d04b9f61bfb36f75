"""Pipe-delimited terminology releases: atoms, semantic types and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layouts and rules of the release.
ATOM_COLUMNS = "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()
TYPE_COLUMNS = "CUI TUI STN STY ATUI CVF".split()
SOURCES = ["MTH", "CHV", "MEDLINEPLUS", "ICD10CM", "ICD9CM", "SNOMEDCT_US", "MSH", "NCI", "HPO"]
SOURCE_TYPES = {"MSH": ["MH", "ET", "EP", "EN", "PEP"]}
SOURCE_DOMAINS = {"NCI": ["condition", "symptom", "procedure"], "HPO": ["condition", "symptom", "observation"]}
DOMAIN_ORDER = ["condition", "symptom", "drug", "procedure", "measurement", "device", "anatomy", "observation", "other"]
DOMAINS = {
    "condition": "T019 T020 T037 T046 T047 T048 T049 T050 T190 T191", "symptom": "T184", "drug": "T121 T195 T200 T125 T129 T131 T127 T109 T197",
    "procedure": "T058 T060 T061", "measurement": "T059 T034 T201", "device": "T074 T075 T203", "anatomy": "T017 T018 T021 T022 T023 T024 T025 T026 T029 T030 T031", "observation": "T033",
}
NAME_TYPES = {"SNOMEDCT_US": ["PT", "FN"], "RXNORM": ["IN", "PIN", "MIN", "SCD", "SBD", "BN", "GPCK", "BPCK", "SCDF", "SBDF"], "MSH": ["MH", "NM"], "LNC": ["LC", "LN"], "ICD10CM": ["PT"], "ICD9CM": ["PT"]}
LAY, ABBREVIATIONS, BRANDS = ["CHV", "MEDLINEPLUS"], ["AB", "ACR", "AA"], ["BN", "SBD", "SBDC", "SBDF", "SBDG", "BPCK"]


def read(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Rows of a file, of its parts or of its gzip; no quoting, a trailing bar on each line, empty for missing."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_end"])
    df = spark.read.option("sep", "|").option("quote", "").option("escape", "").schema(schema).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def wanted(atoms: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """English, unsuppressed atoms of the sources, of the term types that count in theirs."""
    ok = (F.col("LAT") == "ENG") & (F.col("SUPPRESS") == "N") & F.col("SAB").isin(sources or SOURCES)
    for sab, types in SOURCE_TYPES.items():
        ok = ok & ((F.col("SAB") != sab) | F.col("TTY").isin(types))
    return atoms.filter(ok)


def domains(types: DataFrame) -> DataFrame:
    """CUI, domain: the first of DOMAIN_ORDER among the types of a concept."""
    rank = F.lit(len(DOMAIN_ORDER))
    for d, tuis in DOMAINS.items():
        rank = F.when(F.col("TUI").isin(tuis.split()), F.lit(DOMAIN_ORDER.index(d) + 1)).otherwise(rank)
    return types.groupBy("CUI").agg(F.min(rank).alias("r")).select("CUI", F.element_at(F.array(*map(F.lit, DOMAIN_ORDER)), F.col("r")).alias("domain"))


def in_domain(atoms: DataFrame, by_cui: DataFrame) -> DataFrame:
    """Atoms with their concept's domain, without those whose source does not count in it."""
    x = atoms.join(by_cui, "CUI", "left").withColumn("domain", F.coalesce("domain", F.lit("other")))
    for sab, ds in SOURCE_DOMAINS.items():
        x = x.filter((F.col("SAB") != sab) | F.col("domain").isin(ds))
    return x


def term_type() -> Column:
    return (F.when(F.col("SAB").isin(LAY), "lay").when(F.col("TTY").isin(ABBREVIATIONS), "abbreviation").when((F.col("SAB") == "RXNORM") & F.col("TTY").isin(BRANDS), "brand").otherwise("clinical"))


def concepts(atoms: DataFrame) -> DataFrame:
    """CUI, name: the preferred name of the house source, else any preferred one, else the first; by atom id."""
    pref = (F.col("TS") == "P") & (F.col("STT") == "PF") & (F.col("ISPREF") == "Y")
    rank = F.when((F.col("SAB") == "MTH") & pref, 0).when(pref, 1).otherwise(2)
    return atoms.groupBy("CUI").agg(F.min_by("STR", F.struct(rank, "AUI")).alias("name")).select("CUI", F.substring("name", 1, 1000).alias("name"))


def synonyms(atoms: DataFrame) -> DataFrame:
    """CUI, term, term_type, source, each once; terms over 1000 characters are left out."""
    return atoms.filter(F.length("STR") <= 1000).select("CUI", F.col("STR").alias("term"), term_type().alias("term_type"), F.concat(F.lit("UMLS/"), "SAB").alias("source")).distinct()


def source_codes(atoms: DataFrame) -> DataFrame:
    """SAB, code, name of the codes of sources that have some; the best term type names a code, then the first atom."""
    rank = F.lit(99)
    for sab, types in NAME_TYPES.items():
        at = F.array_position(F.array(*map(F.lit, types)), F.col("TTY"))
        rank = F.when((F.col("SAB") == sab) & (at > 0), at).otherwise(rank)
    x = atoms.filter(F.col("SAB").isin(list(NAME_TYPES)) & (F.col("CODE") != "NOCODE") & (F.length("CODE") <= 50))
    return x.groupBy("SAB", F.col("CODE").alias("code")).agg(F.min_by("STR", F.struct(rank, "AUI")).alias("name"))


def code_links(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.col("SAB").isin(list(NAME_TYPES)) & (F.col("CODE") != "NOCODE")).select("CUI", "SAB", F.col("CODE").alias("code")).distinct()


def version(path: Column) -> Column:
    """The release named in a path, else unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(\d{4}A[AB])", 1), F.lit("")), F.lit("unknown"))
