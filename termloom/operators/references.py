"""Orphan references: sorted parent arrays per key range, probed by binary search in vectorised batches.

Parent keys are cut into ranges; each range is one sorted array. References go to the range of their key. A range with
many references (a hot key may hold a third of all rows) is split into salts by row id, and its parents, which are few
per range, are repeated for each salt. A task streams: the parents of a (range, salt) first, then its references in
Arrow batches, so it holds one range's parents and one batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import cut, width

SPLIT_SAMPLE = 100_000  # keys that place the range bounds; the result does not depend on them
ROWS_PER_SALT = 2_000_000
PARENTS_PER_RANGE = 500_000  # that a task holds
NEVER, ALWAYS = -(2**31), 2**31 - 1


def orphans(refs: DataFrame, parents: DataFrame, rows_per_salt: int = ROWS_PER_SALT, ranges: int | None = None) -> DataFrame:
    """Rows of ``refs`` whose reference is not good, with ``reason``.

    refs: tbl, row_id, key (string), at (date or null), period (string or null). parents: key, valid_start, valid_end.
    ``missing``: no parent has the key. ``deleted``: its valid_end is before ``at``. ``later``: its valid_start is
    after ``at``. A null date decides nothing; a null key is no reference and gives no row; repeated parents count as
    one that is valid from the first start to the last end (null: unbounded). Empty parents make every reference
    missing; empty refs give an empty result. Other columns of the inputs are ignored."""
    spark = refs.sparkSession
    parents = parents.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.max(F.col("valid_start").isNull()).alias("s0"), F.min("valid_start").alias("s"), F.max(F.col("valid_end").isNull()).alias("e0"), F.max("valid_end").alias("e"))
    parents = parents.select("key", F.when(F.col("s0"), NEVER).otherwise(F.unix_date("s")).cast("int").alias("a"), F.when(F.col("e0"), ALWAYS).otherwise(F.unix_date("e")).cast("int").alias("b"))
    parents = cut(parents)
    n = ranges or max(width(spark), -(-parents.count() // PARENTS_PER_RANGE))
    refs = refs.filter(F.col("key").isNotNull()).select("tbl", "row_id", "key", F.unix_date("at").alias("day"), "period")
    sample = sorted(r[0] for r in parents.select("key").orderBy(F.xxhash64("key"), "key").limit(SPLIT_SAMPLE).collect())  # bounded
    bounds = np.array(sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else [], dtype="U")

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(dtype="U"), side="right").astype("int32"))

    refs, parents = refs.withColumn("rng", range_of("key")), parents.withColumn("rng", range_of("key"))
    sizes = {r["rng"]: -(-r["n"] // rows_per_salt) for r in refs.groupBy("rng").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per range
    many = {k: v for k, v in sizes.items() if v > 1}
    first, slots = {}, 0  # each range and salt is a partition of its own
    for k in range(len(bounds) + 1):
        first[k], slots = slots, slots + max(1, sizes.get(k, 1))
    lead = F.element_at(F.array(*[F.lit(v) for v in first.values()]), F.col("rng") + 1)
    salts: Column = F.lit(1)
    if many:
        salts = F.coalesce(F.create_map(*[x for k, v in many.items() for x in (F.lit(k), F.lit(v))])[F.col("rng")], F.lit(1))
    refs = refs.withColumn("salt", F.pmod(F.xxhash64("tbl", "row_id"), salts.cast("bigint")).cast("int")).withColumn("kind", F.lit(1))
    parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int")))).withColumn("kind", F.lit(0))
    both = refs.unionByName(parents, allowMissingColumns=True).repartitionById(slots, (lead + F.col("salt")).cast("int")).sortWithinPartitions("rng", "salt", "kind", "key")
    return both.mapInPandas(_probe, "tbl string, row_id bigint, period string, reason string")


def _probe(batches):
    group, held, arrays = None, [], None
    for pdf in batches:
        if pdf.empty:
            continue
        rng, salt, kind = pdf["rng"].to_numpy(), pdf["salt"].to_numpy(), pdf["kind"].to_numpy()
        cut = np.flatnonzero((rng[1:] != rng[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(pdf)]):
            part, at = pdf.iloc[lo:hi], (int(rng[lo]), int(salt[lo]))
            if at != group:
                group, held, arrays = at, [], None
            if kind[lo] == 0:
                held.append(part)
                continue
            if arrays is None:
                p = pd.concat(held) if held else part.iloc[:0]
                arrays = p["key"].to_numpy(dtype="U"), p["a"].fillna(NEVER).to_numpy(dtype="int64"), p["b"].fillna(ALWAYS).to_numpy(dtype="int64")
                order = np.argsort(arrays[0], kind="stable")  # the JVM sorts by UTF-8 bytes, numpy by code points
                arrays, held = tuple(x[order] for x in arrays), []
            yield _misses(part, *arrays)


def _misses(refs: pd.DataFrame, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    key, day = refs["key"].to_numpy(dtype="U"), refs["day"].to_numpy(dtype=float)
    reason = np.full(len(refs), None, dtype=object)
    if len(keys) == 0:
        reason[:] = "missing"
    else:
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[i] == key
        with np.errstate(invalid="ignore"):
            reason[there & (start[i] > day)] = "later"
            reason[there & (end[i] < day)] = "deleted"
        reason[~there] = "missing"
    bad = np.array([r is not None for r in reason])
    return pd.DataFrame({"tbl": refs["tbl"].to_numpy()[bad], "row_id": refs["row_id"].to_numpy()[bad].astype("int64"), "period": refs["period"].to_numpy()[bad], "reason": reason[bad]})


def printed_key(code: Column) -> Column:
    """A printed code without dots, blanks, case and dashes; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(code, r"[.\s\- ‐-―]", "")), F.lit(""))


def counts(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Per table and period: references, and orphans by reason."""
    total = refs.filter(F.col("key").isNotNull()).groupBy("tbl", F.coalesce("period", F.lit("none")).alias("period")).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = found.groupBy(F.col("tbl").alias("t_"), F.coalesce("period", F.lit("none")).alias("p_")).agg(
        *[F.sum((F.col("reason") == r).cast("bigint")).alias(f"n_{r}") for r in ("missing", "deleted", "later")])
    out = total.join(bad, (F.col("tbl") == F.col("t_")) & (F.col("period") == F.col("p_")), "left")
    return out.select("tbl", "period", "n_refs", *[F.coalesce(f"n_{r}", F.lit(0)).cast("bigint").alias(f"n_{r}") for r in ("missing", "deleted", "later")])
