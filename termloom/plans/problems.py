"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import hierarchy, history, intervals, packed, references, units
from termloom.session import table

SEP = "\x1f"


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    return units.segment_units(units.measured(table(spark, d, "ns_msi_sample"), table(spark, d, "fee_record"), table(spark, d, "feed_info")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.recorded_otherwise(_segmented(spark, d))


def p1_blind(spark: SparkSession, d: str) -> DataFrame:
    """The declarations of one history in five are hidden; how many of them the changepoint search gives back."""
    rows = units.measured(table(spark, d, "ns_msi_sample"), table(spark, d, "fee_record"), table(spark, d, "feed_info"))
    return units.recovered(units.segment_units(units.blinded(rows)))


def p1_histories(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_changes(_segmented(spark, d))


def _references(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    concept = table(spark, d, "concept")
    edge = table(spark, d, "concept_relationship").select(
        F.lit("concept_relationship").alias("tbl"), F.col("edge_id").alias("row_id"), F.col("concept_id_2").cast("string").alias("key"),
        F.col("valid_start").alias("at"), F.year("valid_start").cast("string").alias("period"))
    ids = concept.select(F.col("concept_id").cast("string").alias("key"), "valid_start", "valid_end")
    term = table(spark, d, "index_term").select(
        F.lit("index_term").alias("tbl"), F.col("entry_id").alias("row_id"), references.printed_key(F.col("code")).alias("key"),
        F.make_date(F.col("release_year") - 1, F.lit(10), F.lit(1)).alias("at"), F.col("release_year").cast("string").alias("period"))
    codes = concept.filter(F.col("vocabulary_id") == "ICD10CM").select(references.printed_key(F.col("code")).alias("key"), "valid_start", "valid_end")
    return [(edge, ids), (term, codes)]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    (a, b), (c, e) = _references(spark, d)
    return references.orphans(a, b).unionByName(references.orphans(c, e))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tbl", "row_id", "reason").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    (a, _), (c, _) = _references(spark, d)
    return references.counts(_orphans(spark, d), a.unionByName(c))


def _snapshot_states(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "concept_snapshot").filter(F.col("concept_id").isNotNull())
    state = F.to_json(F.struct(history.folded_name(F.col("name")).alias("n"), F.col("valid_end").alias("e")))
    return t.select(F.col("concept_id").cast("string").alias("entity"), F.col("snapshot_date").alias("at"), state.alias("state"),
                    F.col("received_at").alias("received"), F.col("snapshot_row_id").alias("row_id"))


def _fee_states(spark: SparkSession, d: str) -> DataFrame:
    value = units.with_common_units(table(spark, d, "ns_msi_sample"), table(spark, d, "feed_info"), ("code", "modifier", "locality", "effective_start", "loaded_at"))
    entity = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("code", "modifier", "locality")])
    return value.select(entity.alias("entity"), F.col("effective_start").alias("at"), F.col("units_common").cast("string").alias("state"), F.col("loaded_at").alias("received"), F.col("fee_row_id").alias("row_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = history.as_found(history.versions(_snapshot_states(spark, d)), "concept_snapshot")
    b = history.as_found(history.versions(_fee_states(spark, d)), "ns_msi_sample")
    return a.unionByName(b)


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tbl, rows in (("concept_snapshot", _snapshot_states(spark, d)), ("ns_msi_sample", _fee_states(spark, d))):
        one = history.versions(rows).select(F.lit(tbl).alias("tbl"), "entity", F.col("version").cast("int").alias("version"), "state", "valid_from", "valid_to")
        out = one if out is None else out.unionByName(one)
    return out


def _links(spark: SparkSession, d: str) -> DataFrame:
    node = lambda tbl, year, c: F.concat_ws(SEP, F.lit(tbl), year.cast("string"), c.cast("string"))
    rp = table(spark, d, "release_parent").filter("release_year is not null and (code is not null or parent_code is not null)")
    year = F.col("release_year")
    known = rp.select(F.when(F.col("code").isNotNull(), node("release_parent", year, F.col("code"))).otherwise(node("release_parent", year, F.col("parent_code"))).alias("node"),
                      F.when(F.col("code").isNotNull() & F.col("parent_code").isNotNull(), node("release_parent", year, F.col("parent_code"))).alias("parent"))
    cr = table(spark, d, "concept_relationship").filter(F.col("relationship_id").isin("is_a", "subsumes") & (F.col("concept_id_1").isNotNull() | F.col("concept_id_2").isNotNull()))
    up = F.col("relationship_id") == "is_a"
    child, parent = F.when(up, F.col("concept_id_1")).otherwise(F.col("concept_id_2")), F.when(up, F.col("concept_id_2")).otherwise(F.col("concept_id_1"))
    zero = F.lit(0)
    edge = cr.select(node("concept_relationship", zero, F.coalesce(child, parent)).alias("node"), F.when(child.isNotNull() & parent.isNotNull(), node("concept_relationship", zero, parent)).alias("parent"))
    return known.unionByName(edge)


def _named(df: DataFrame, *cols: str) -> DataFrame:
    part = F.split("node", SEP, 3)
    return df.select(part[0].alias("tbl"), part[1].cast("int").alias("release_year"), part[2].alias("node"), *cols)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform("path", lambda x: F.split(x, SEP, 3)[2])
    path = F.when(F.col("kind") == "tree", F.array_join(names, ">")).otherwise(F.concat(F.lit("#"), "kind"))
    return _named(hierarchy.resolve(_links(spark, d)).withColumn("path", path), "path")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    out = hierarchy.summary(hierarchy.resolve(links), links).withColumn("root", F.split("root", SEP, 3)[2])
    return _named(out, "kind", F.col("depth").cast("int").alias("depth"), "root", "n_descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    out = hierarchy.closure(links, hierarchy.resolve(links)).filter("distance > 0").withColumn("ancestor", F.split("ancestor", SEP, 3)[2])
    return _named(out, "ancestor", F.col("distance").cast("int").alias("distance"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tbl, key, fields in (("patterns", "pattern_id", ("targets",)), ("senses", "sense_id", ("cues",)), ("annotate_sentences", "item_id", ("expect", "forbid"))):
        t = table(spark, d, tbl)
        for f in fields:
            one = t.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.lit(f).alias("field"), F.col(f).alias("text"))
            out = one if out is None else out.unionByName(one)
    return out


#: In ``expect`` a bar joins alternatives and square brackets hold tags; a list of cues may stand in brackets.
RULES = {"expect": packed.Rule(tuple(s for s in packed.SEPARATORS if s != "|"), keep_brackets=True), "cues": packed.Rule(unwrap=True)}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(_fields(spark, d), RULES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ns_msi_sample").select(F.col("code").alias("key"), F.col("effective_start").alias("first_day"), F.col("effective_end").alias("last_day"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return intervals.periods_and_gaps(rows.filter("key is not null")).select(
        F.col("key").alias("code"), "kind", day("first_day").alias("from_date"), F.coalesce(day("last_day"), F.lit("open")).alias("to_date"))


QUERIES = {f.__name__: f for f in (p1_found, p1_blind, p1_histories, p2_found, p2_counts, p3_found, p3_history, p5_found, p5_nodes, p5_descendants, p6_found, p7_found)}
