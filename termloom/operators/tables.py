"""Table maintenance as rewrites: upserts, refresh by source, retirement, ids, first and last wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import pinned, width


def _on(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], clear: tuple[str, ...] = ()) -> DataFrame:
    """``new`` rows replace the ``update`` columns of rows with their key (columns in ``clear`` become null there) and are added
    where no row has it. ``new`` must be unique per key; one shuffle per side."""
    cols = old.columns
    j = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), _on("o", "n", keys), "full")
    both, fresh = F.col("o._o") & F.col("n._n"), F.col("o._o").isNull()
    have = set(new.columns)

    def value(c: str) -> Column:
        there = F.col(f"n.{c}") if c in have else F.lit(None)
        if c in clear:
            return F.when(both, F.lit(None)).when(fresh, there).otherwise(F.col(f"o.{c}"))
        if c in update:
            return F.when(F.col("n._n"), there).otherwise(F.col(f"o.{c}"))
        return F.when(fresh, there).otherwise(F.col(f"o.{c}"))

    return j.select(*[value(c).cast(old.schema[c].dataType).alias(c) for c in cols])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` are added."""
    add = new.alias("n").join(old.select(*keys).distinct().alias("o"), _on("n", "o", keys), "left_anti")
    return old.unionByName(add.select(*old.columns))


def refresh_source(old: DataFrame, new: DataFrame, source: Column) -> DataFrame:
    """Rows of the source are replaced by ``new``; ``source`` is a condition on the old rows."""
    return old.filter(~F.coalesce(source, F.lit(False))).unionByName(new.select(*old.columns))


def retire(old: DataFrame, present: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Valid rows whose key is missing from ``present`` end on ``day``."""
    j = old.alias("o").join(present.select(*keys).distinct().withColumn("_p", F.lit(True)).alias("p"), _on("o", "p", keys), "left")
    end = F.when(F.col("o.valid_end").isNull() & F.col("_p").isNull(), day).otherwise(F.col("o.valid_end"))
    return j.select(*[end.alias(c) if c == "valid_end" else F.col(f"o.{c}") for c in old.columns])


def terminate(ended: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """ended(key, day) without those that have a row of later(key, day) after their day."""
    return ended.alias("e").join(later.alias("l"), (F.col(f"e.{key}") == F.col(f"l.{key}")) & (F.col("l.day") > F.col("e.day")), "left_anti")


def assign_ids(known: DataFrame, new: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys and id of ``new``: the known id of a key, else the next ones in order of the keys.

    New keys are numbered by range: rows are sorted by key in partitions, counts per partition give the offsets, so no
    single task ranks all keys."""
    spark = new.sparkSession
    new = new.select(*keys).distinct()
    old = new.join(known.select(*keys, id_col).groupBy(*keys).agg(F.min(id_col).alias(id_col)), keys)
    fresh = new.join(known.select(*keys).distinct(), keys, "left_anti")
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"]
    n = width(spark)
    placed = pinned(fresh.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    start, offsets = top, []
    for p, k in sizes:
        offsets.append((p, start))
        start += k
    off = F.create_map(*[F.lit(x) for o in offsets for x in o])[F.col("_p")] if offsets else F.lit(0)
    ranked = placed.withColumn(id_col, (F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) + off).cast("bigint"))
    return old.select(*keys, id_col).unionByName(ranked.select(*keys, id_col))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; an aggregation, so hot keys combine map-side."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def conflicts(rows: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Per key: rows, and rows whose values differ from those of the first. Repeated value sets are counted first, so
    the window over a key sees its distinct values only."""
    v = F.struct(*values)
    sets = rows.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    first = sets.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.min_by("_n", "_first").alias("_same"))
    return first.select(*keys, "n_rows", (F.col("n_rows") - F.col("_same")).alias("n_conflicts"))


def mode(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most common value of each key, non-empty before empty, the earliest on ties."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_f"))
    filled = F.coalesce(F.col(value) != "", F.lit(False))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct(filled, "_n", -F.col("_f"))).alias(value))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Each left row with the ``value`` of the last right row of its key at or before ``at``.

    Both sides are merged by one window per key and month: within a month the last value seen is carried, and the last
    value of each month (one row per key and month) is carried over months, so a hot key is split by time."""
    month = lambda c: F.date_trunc("month", c)
    r = right.groupBy(key, at).agg(F.max_by(value, tie).alias("_v")).withColumn("_m", month(F.col(at)))
    last = r.groupBy(key, "_m").agg(F.max_by("_v", at).alias("_last"))
    marks = left.select(key, month(F.col(at)).alias("_m")).distinct().join(last, [key, "_m"], "full")
    before = Window.partitionBy(key).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(key, "_m", F.last("_last", True).over(before).alias("_carry"))
    left = left.withColumn("_m", month(F.col(at)))
    both = left.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_k", F.lit(1)).unionByName(r.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key, "_m").orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_in", F.last("_v", True).over(w)).filter("_k = 1").join(marks, [key, "_m"], "left")
    return got.withColumn(value, F.coalesce("_in", "_carry")).drop("_m", "_v", "_k", "_in", "_carry")


def carry_forward(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with each of ``values`` filled from the last row before it, by key, bucket and order, that has one.

    Within a bucket (a page, say) the last value seen is carried; the last one of each bucket, a row per key and bucket,
    is carried over buckets, so a hot key is split. ``bucket`` and ``order`` must not be null; null keys are keys."""
    key = F.to_json(F.struct(*keys))
    rows = rows.withColumn("_k", key).withColumn("_b", bucket)
    here = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("_k", "_b").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v"))))["v"].alias(f"_e_{c}") for c in values])
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_k", "_b", *[F.last(f"_e_{c}", True).over(before).alias(f"_c_{c}") for c in values])
    out = rows.select("*", *[F.last(c, True).over(here).alias(f"_i_{c}") for c in values]).join(ends, ["_k", "_b"])
    rest = [c for c in rows.columns if c not in values and c not in ("_k", "_b")]
    return out.select(*rest, *[F.coalesce(f"_i_{c}", f"_c_{c}").alias(c) for c in values])
