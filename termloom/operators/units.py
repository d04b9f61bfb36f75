"""Quantities in different units: exact penalised changepoint search per source history, on log values.

A history is the sequence of values of one field, feed and code in time. Each value has a log residual against the
level of its code in the common unit. Known factors are the only levels a history may sit on, so the search is over
sequences of units: the cost of unit u at a value is the capped squared distance of its residual to -ln(factor u),
plus a weight if a declaration (in the value, the description or by the feed) names another unit, plus a penalty for
each change of unit. The minimum over all segmentations is exact (dynamic programming). The weight exceeds what a
segmentation could ever save by contradicting a declaration, so declared units win and undeclared values take the
unit their level matches.

A history may be of any length. Rows are range-partitioned by history and time; a history that spans partitions is
solved from one small transition matrix per partition, in (min, +) algebra, so the result does not depend on the
partitioning and no history has to fit in one task. What a partition must know of the others comes from two streams over
these matrices, forward and backward; it is shipped with the tasks while it is small and joined by partition beyond that.

A value without a declaration whose code has no declared value anywhere has no level to go by: its unit stays null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import quantity as Q
from termloom.session import cut, maybe_broadcast, pinned, small_enough, width

#: Units and their factors to the common unit of the quantity; the first is the common unit.
UNITS = {
    "units": (("msu", 1.0), ("point", 0.05), ("rvu", 2.5), ("milli_msu", 0.001)),
    "amount": (("dollar", 1.0), ("cent", 0.01), ("hundred_dollars", 100.0), ("thousand_dollars", 1000.0)),
    "duration": (("minute", 1.0), ("hour", 60.0), ("time_unit", 15.0)),
}
STATES = 4
CAP, PENALTY = 9.0, 4.0
TRUST = CAP + 2 * PENALTY + 1
ROWS_AT_ONCE = 60_000  # of a partition, which a Python worker holds whole
MOST_SHIPPED = 20_000  # partitions' edges that are shipped with the tasks; more are joined
HISTORY = ["tbl", "field", "feed", "code"]


def factor_of(field: Column, unit: Column) -> Column:
    pairs = [x for q, us in UNITS.items() for u, f in us for x in (F.lit(f"{q}/{u}"), F.lit(repr(f)).cast("decimal(12,6)"))]
    return F.create_map(*pairs)[F.concat_ws("/", field, unit)]


def measured(fees: DataFrame, records: DataFrame, feeds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per value: tbl, row_id, field, feed, code, at (date), seq, value, number, declared (unit or null), clock.

    Values that are null, a percentage or without a number give no row. The tables may be empty; a feed without a row
    in ``feeds`` declares nothing. ``feeds`` is read as given and joined (a few rows per feed, size-checked). Columns of the fees in ``keep`` go along in
    a struct ``kept``."""
    def part(tbl: str, rows: DataFrame, key: str, q: str, at, value, text) -> DataFrame:
        rows = rows.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.lit(q).alias("field"), "feed", "code", at.alias("at"), value.alias("value"), text.alias("text"), *([F.struct(*keep).alias("kept")] if keep and tbl == "ns_msi_sample" else [])).filter(F.col("value").isNotNull())
        kept = ["kept"] if "kept" in rows.columns else []
        clock = Q.is_clock(F.col("value")) if q == "duration" else F.lit(False)
        said = F.coalesce(Q.unit_in_value(F.col("value"), q), Q.unit_in_text(F.col("text"), q))
        return rows.select("tbl", "row_id", "field", "feed", "code", "at", Q.number(F.col("value")).alias("number"), clock.alias("clock"), said.alias("said"), *kept)

    none = F.lit(None).cast("date")
    parts = [part("ns_msi_sample", fees, "fee_row_id", q, F.col("effective_start"), F.col(q), F.col("description")) for q in ("units", "amount")]
    parts += [part("fee_record", records, "record_id", q, none, F.try_element_at("fee_values", F.lit(q)), F.concat_ws(" ", "description")) for q in UNITS]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    one_feed = feeds.groupBy(F.col("feed").alias("feed_")).agg(*[F.min(c).alias(c) for c in ("units_unit", "amount_unit", "duration_unit")])
    rows = rows.filter(F.col("number").isNotNull()).join(one_feed, F.col("feed") == F.col("feed_"), "left")
    by_feed = F.when(F.col("field") == "units", F.col("units_unit")).when(F.col("field") == "amount", F.col("amount_unit")).otherwise(F.col("duration_unit"))
    declared = F.when(F.col("clock"), F.lit("minute")).otherwise(F.coalesce("said", by_feed))
    return rows.select("tbl", "row_id", "field", "feed", "code", "at", "number", "clock", declared.alias("declared"), *(["kept"] if keep else []))


def common(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """Adds common_value, in hundredths of the common unit."""
    exact = (F.col("number") * factor_of(F.col("field"), F.col(unit)) * 100).cast("decimal(38,6)")
    return rows.withColumn("common_value", F.round(exact, 0).cast("bigint"))


def _costs(pdf: pd.DataFrame) -> np.ndarray:
    levels = {q: np.array([-math.log(f) for _, f in us] + [np.inf] * (STATES - len(us))) for q, us in UNITS.items()}
    field = pdf["field"].to_numpy()
    y = pdf["y"].to_numpy(dtype=float)
    out = np.empty((len(pdf), STATES))
    for q, lv in levels.items():
        m = field == q
        with np.errstate(invalid="ignore"):
            d = np.minimum((y[m, None] - lv[None, :]) ** 2, CAP)
        out[m] = np.where(np.isinf(lv)[None, :], np.inf, np.where(np.isnan(d), 0.0, d))
    say = pdf["declared_ix"].to_numpy()
    rows = np.flatnonzero(say >= 0)
    keep = out[rows, say[rows]].copy()
    out[rows] += TRUST
    out[rows, say[rows]] = keep
    return out


def _solve(costs: np.ndarray, lo: np.ndarray, hi: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Units of all histories of a partition, rows lo to hi each, given the cost of arriving and of going on in each unit.

    The recursion goes over positions, with all histories that reach a position in one array; only histories longer
    than the rest run on alone."""
    n = hi - lo
    by = np.argsort(-n, kind="stable")
    lo, n, back = lo[by], n[by], np.zeros((len(costs), STATES), dtype="int8")
    v = enter[by].copy()
    end = np.empty(len(by), dtype=int)
    for step in range(int(n[0])):
        k = int(np.searchsorted(-n, -step, side="left"))  # histories with a row at this position
        at = lo[:k] + step
        j = v[:k].argmin(axis=1)
        best = v[np.arange(k), j] + PENALTY
        stay = v[:k] <= best[:, None]
        back[at] = np.where(stay, np.arange(STATES), j[:, None])
        v[:k] = np.where(stay, v[:k], best[:, None]) + costs[at]
    end[:] = (v + leave[by]).argmin(axis=1)
    out = np.empty(len(costs), dtype=int)
    for step in range(int(n[0]) - 1, -1, -1):
        k = int(np.searchsorted(-n, -step, side="left"))
        at = lo[:k] + step
        out[at] = end[:k]
        end[:k] = back[at, end[:k]]
    return out


def _matrix(costs: np.ndarray) -> list[float]:
    """Cheapest way through the rows from each unit of the row before to each unit of the last row."""
    v = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for c in costs:
        v = np.minimum(v, v.min(axis=1, keepdims=True) + PENALTY) + c
    return v.ravel().tolist()


def _runs(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    h = pdf["history"].to_numpy()
    at = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
    return list(zip(at[:-1], at[1:]))


def _whole(batches) -> pd.DataFrame:
    got = [b for b in batches if len(b)]
    return pd.concat(got, ignore_index=True) if got else pd.DataFrame()


def _edges(batches):
    """The matrices of the outermost histories of a partition, which may go on in others."""
    pdf = _whole(batches)
    if pdf.empty:
        return
    costs, runs = _costs(pdf), _runs(pdf)
    for k in sorted({0, len(runs) - 1}):
        lo, hi = runs[k]
        yield pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "history": [pdf["history"].iloc[lo]], "m": [_matrix(costs[lo:hi])]})


def _carried(forward: bool):
    """Streams the edges of each history in order (or backwards): the cost of arriving from what came before."""

    def run(batches):
        now, v = None, np.zeros(STATES)
        for pdf in batches:
            out = []
            for part, history, m in zip(pdf["part"], pdf["history"], pdf["m"]):
                if history != now:
                    now, v = history, np.zeros(STATES)
                out.append(v.tolist())
                m = np.asarray(m, dtype=float).reshape(STATES, STATES)
                v = (v[:, None] + m).min(axis=0) if forward else (v[None, :] + m).min(axis=1)
            yield pd.DataFrame({"part": pdf["part"], "history": pdf["history"], "v": out})

    return run


def _boundaries(edges: DataFrame) -> DataFrame:
    """part, history, enter, leave for the histories that lie in several partitions; a row per such partition."""
    many = edges.groupBy("history").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("history")
    edges = cut(edges.join(many, "history").repartition("history"))
    go = edges.sortWithinPartitions("history", "part").mapInPandas(_carried(True), "part int, history string, v array<double>")
    back = edges.sortWithinPartitions("history", F.desc("part")).mapInPandas(_carried(False), "part int, history string, v array<double>")
    return go.withColumnRenamed("v", "enter").join(back.withColumnRenamed("v", "leave"), ["part", "history"])


def segment_units(rows: DataFrame, partitions: int | None = None, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """Adds ``unit`` and ``changed`` (a changepoint of its history begins here) to the rows of ``measured``.

    Nulls in feed or code make histories of their own; ties in time are ordered by row_id; a value of zero has no
    level and costs nothing in any unit; a code without any declared value has no level, and its unit is null. An empty
    input gives an empty result."""
    spark = rows.sparkSession
    ix = F.lit(-1)
    for us in UNITS.values():
        for i, (u, _) in enumerate(us):
            ix = F.when(F.col("declared") == u, F.lit(i)).otherwise(ix)
    log = F.when(F.col("number") > 0, F.log(F.col("number").cast("double")))
    level = F.log(factor_of(F.col("field"), F.col("declared")).cast("double"))
    rows = cut(rows.withColumn("lg", log).withColumn("up", level).withColumn("declared_ix", ix.cast("int")))  # the texts are parsed once
    n = partitions or max(width(spark), 1 + rows.count() // ROWS_AT_ONCE)
    base = rows.filter("up is not null").groupBy(F.col("field").alias("f_"), F.coalesce("code", F.lit("")).alias("c_"), F.col("code").isNull().alias("z_")).agg(F.avg(F.col("lg") + F.col("up")).alias("base"), F.lit(True).alias("known"))
    on = (F.col("field") == F.col("f_")) & (F.coalesce("code", F.lit("")) == F.col("c_")) & (F.col("code").isNull() == F.col("z_"))
    rows = rows.join(maybe_broadcast(base), on, "left").withColumn("known", F.coalesce("known", F.lit(False)) | (F.col("declared_ix") >= 0))
    rows = rows.withColumn("y", F.col("lg") - F.col("base")).withColumn("history", F.to_json(F.struct(*HISTORY)))
    order = ["history", "at", "row_id"]
    rows = rows.drop("lg", "up", "base", "f_", "c_", "z_").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = pinned(rows)
    edges = rows.select("part", "history", "field", "y", "declared_ix").mapInPandas(_edges, "part int, history string, m array<double>")
    known = cut(_boundaries(cut(edges)))
    names = {q: np.array([u for u, _ in us] + [None] * (STATES - len(us)), dtype=object) for q, us in UNITS.items()}
    hidden = ["y", "declared_ix", "history", "part", "known"]
    keep = [c for c in rows.columns if c not in hidden]

    def solved(pdf: pd.DataFrame, edge: dict) -> pd.DataFrame:
        part, costs = int(pdf["part"].iloc[0]), _costs(pdf)
        runs = np.array(_runs(pdf))
        enter, leave = np.zeros((len(runs), STATES)), np.zeros((len(runs), STATES))
        for k in {0, len(runs) - 1}:
            enter[k], leave[k] = edge.get((part, pdf["history"].iloc[runs[k, 0]]), (0.0, 0.0))
        unit = _solve(costs, runs[:, 0], runs[:, 1], enter, leave)
        changed = np.zeros(len(pdf), dtype=bool)
        changed[1:] = (unit[1:] != unit[:-1])
        changed[runs[:, 0]] = False
        field, text = pdf["field"].to_numpy(), np.empty(len(pdf), dtype=object)
        for q, us in names.items():
            text[field == q] = us[unit[field == q]]
        told = pdf["known"].to_numpy(dtype=bool)
        text[~told] = None
        return pdf[keep].assign(unit=text, changed=changed & told)

    schema = rows.select(*keep).schema.add("unit", "string").add("changed", "boolean")
    if small_enough(known, most_shipped):
        edge = {(r["part"], r["history"]): (list(r["enter"]), list(r["leave"])) for r in known.collect()}  # at most most_shipped

        def alone(batches):
            pdf = _whole(batches)
            if len(pdf):
                yield solved(pdf, edge)

        return rows.mapInPandas(alone, schema)

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in schema.names})
        left = left.assign(_at=pd.to_datetime(left["at"])).sort_values(["history", "_at", "row_id"], na_position="first", kind="stable").drop(columns="_at").reset_index(drop=True)
        return solved(left, {(int(p), h): (list(e), list(v)) for p, h, e, v in zip(right["part"], right["history"], right["enter"], right["leave"])})

    return rows.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(met, schema)


def recorded_otherwise(segmented: DataFrame) -> DataFrame:
    """The values that are not recorded in the common unit, converted."""
    commons = F.create_map(*[x for q, us in UNITS.items() for x in (F.lit(q), F.lit(us[0][0]))])
    rows = common(segmented.withColumn("unit", F.coalesce("unit", "declared")))
    rows = rows.filter(F.col("clock") | (F.col("unit") != commons[F.col("field")]))
    return rows.select("tbl", "row_id", "field", "common_value").distinct()


def unit_changes(segmented: DataFrame) -> DataFrame:
    """Per history: values, changepoints and the units it uses."""
    return segmented.groupBy(*HISTORY).agg(
        F.count(F.lit(1)).alias("n_values"), F.sum(F.col("changed").cast("int")).alias("n_changes"),
        F.array_join(F.sort_array(F.collect_set("unit")), ",").alias("units_used"))


def blinded(rows: DataFrame, one_in: int = 5) -> DataFrame:
    """``measured`` without the declarations of one history in ``one_in``, chosen by hash; ``hidden`` keeps them."""
    mine = F.pmod(F.xxhash64(F.to_json(F.struct(*HISTORY))), F.lit(one_in)) == 0
    hide = mine & ~F.col("clock")
    return rows.withColumn("hidden", F.when(hide, F.col("declared"))).withColumn("declared", F.when(~hide, F.col("declared")))


def recovered(segmented: DataFrame) -> DataFrame:
    """Per field: hidden units, those that the levels of the other histories of the code recover, and how many are right."""
    h = segmented.filter("hidden is not null")
    got = h.withColumn("given", F.col("unit").isNotNull()).withColumn("right", F.coalesce(F.col("unit") == F.col("hidden"), F.lit(False)))
    odd = F.col("hidden") != F.create_map(*[x for q, us in UNITS.items() for x in (F.lit(q), F.lit(us[0][0]))])[F.col("field")]
    n = lambda c: F.sum(c.cast("bigint"))
    return got.groupBy("field").agg(F.count(F.lit(1)).alias("n_hidden"), n(F.col("given")).alias("n_given"), n(F.col("right")).alias("n_right"),
                                    n(odd).alias("n_not_common"), n(odd & F.col("right")).alias("n_not_common_right"))


def with_common_units(fees: DataFrame, feeds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """fee_row_id, the columns ``keep`` and the units of each fee in hundredths of the common unit, in the unit that ``segment_units`` gives.

    A declaration outweighs any level there, so only histories with a value that declares no known unit are segmented."""
    empty = fees.sparkSession.createDataFrame([], "record_id bigint, feed string, code string, fee_values map<string,string>, description array<string>")
    rows = measured(fees, empty, feeds, keep).filter(F.col("field") == "units").withColumn("h_", F.to_json(F.struct(*HISTORY)))
    if small_enough(rows.filter(factor_of(F.col("field"), F.col("declared")).isNull()).select("row_id"), 0):
        out = common(rows.withColumn("unit", F.col("declared")))
        return out.select(F.col("row_id").alias("fee_row_id"), *[f"kept.{c}" for c in keep], F.col("common_value").alias("units_common")).filter(F.col("units_common").isNotNull())
    undeclared = rows.filter(factor_of(F.col("field"), F.col("declared")).isNull()).select("h_").distinct()
    told = rows.join(undeclared, "h_", "left_anti").withColumn("unit", F.col("declared"))
    levelled = segment_units(rows.join(undeclared, "h_", "left_semi").drop("h_")).withColumn("unit", F.coalesce("unit", "declared"))
    cols = ["row_id", "field", "number", "unit", *(["kept"] if keep else [])]
    out = common(told.select(*cols).unionByName(levelled.select(*cols)))
    return out.select(F.col("row_id").alias("fee_row_id"), *[f"kept.{c}" for c in keep], F.col("common_value").alias("units_common")).filter(F.col("units_common").isNotNull())


__all__ = ["blinded", "common", "measured", "recorded_otherwise", "recovered", "segment_units", "unit_changes", "with_common_units"]
