"""Versions of changing attributes by gaps and islands over all snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(rows: DataFrame) -> DataFrame:
    """rows: entity (string), at (date), state (string), received, row_id. Gives entity, version, valid_from, valid_to, state.

    Of the rows of one entity and date the last received counts; ties go to the larger row_id. This reduction combines
    map-side, and leaves at most one row per entity and day: no entity's group exceeds the days of its history,
    however many rows it holds. A version starts where the hash of the state differs from that of the date before;
    valid_to is the next start, null for the last. A state that returns is a new version. Rows with a null date say
    nothing; null states are states; a null entity is one entity. An empty input gives an empty result."""
    rows = rows.filter(F.col("at").isNotNull())
    day = rows.groupBy("entity", "at").agg(F.max_by("state", F.struct(F.col("received").isNotNull(), "received", "row_id")).alias("state"))
    order = Window.partitionBy("entity").orderBy("at")
    day = day.withColumn("h", F.struct(F.xxhash64("state"), F.length("state")))
    day = day.withColumn("new", (~F.lag("h").over(order).eqNullSafe(F.col("h"))).cast("int"))
    day = day.withColumn("version", F.sum("new").over(order))
    island = day.groupBy("entity", "version").agg(F.min("at").alias("valid_from"), F.min("state").alias("state"))
    return island.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("entity").orderBy("version")))


def folded_name(name) -> object:
    """A name without case and spacing."""
    return F.lower(F.regexp_replace(name, r"[\s  -​ 　]+", ""))


def as_found(out: DataFrame, tbl: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select(F.lit(tbl).alias("tbl"), "entity", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("open")).alias("valid_to"))
