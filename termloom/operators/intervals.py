"""Overlapping and gapped intervals by canonical dyadic blocks.

Days are counted from 0001-01-01 in a domain of 2**22. An interval is the union of at most 42 canonical blocks
(level k, index i: days i*2**k to (i+1)*2**k). Equal blocks of one key fall together map-side, so the group of a key
is bounded by twice the days of its history, however many rows the key holds. Within it, blocks below an ancestor are
dropped (blocks are nested or disjoint: one running maximum), siblings merge upward level by level, and blocks that
touch are coalesced. Several keys are treated at once with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import whole_groups, width

LEVELS = 22
END = 1 << LEVELS
OFFSET = 719162  # days from 0001-01-01 to 1970-01-01


def blocks(lo: Column, hi: Column) -> Column:
    """The canonical blocks of the days lo to hi (exclusive) as array<struct<level, idx>>."""
    out = []
    for k in range(LEVELS + 1):
        size = 1 << k
        a, b = F.floor((lo + (size - 1)) / size).cast("int"), F.floor(hi / size).cast("int")
        left = F.when((a < b) & (a % 2 == 1), F.struct(F.lit(k).alias("level"), a.alias("idx")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("idx")))
        out += [left, right]
    return F.array_distinct(F.array_compact(F.array(*out)))


def periods_and_gaps(rows: DataFrame) -> DataFrame:
    """rows: key (string), first_day, last_day (dates; null last_day: no end). Gives key, kind, first_day, last_day.

    kind ``period`` is a longest run of days in effect, ``gap`` the days between two successive periods; a period
    without an end has a null last_day. Rows without a start or with an end before it are left out; a null key is a
    key; repeated, nested and touching intervals fall together. An empty input gives an empty result."""
    lo = (F.unix_date("first_day") + OFFSET).cast("int")
    hi = F.when(F.col("last_day").isNull(), F.lit(END)).otherwise(F.unix_date("last_day") + OFFSET + 1).cast("int")
    rows = rows.filter(F.col("first_day").isNotNull() & (F.col("last_day").isNull() | (F.col("last_day") >= F.col("first_day"))))
    rows = rows.select("key", lo.alias("lo"), hi.alias("hi")).distinct()
    one = rows.select("key", F.explode(blocks(F.col("lo"), F.col("hi"))).alias("b")).select("key", "b.level", "b.idx").distinct()
    one = one.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key")
    runs = one.mapInPandas(_runs, "key string, kind string, lo int, hi int")
    day = lambda c: F.date_from_unix_date((c - OFFSET).cast("int"))
    return runs.select("key", "kind", day(F.col("lo")).alias("first_day"), F.when(F.col("hi") < END, day(F.col("hi") - 1)).alias("last_day"))


def merge_blocks(key: np.ndarray, level: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the runs of the blocks, sorted; keys are small integers."""
    span = 1 << (LEVELS + 1)
    start = key * span + (idx << level)
    order = np.lexsort((-level, start))
    start, level = start[order], level[order]
    end = start + (1 << level)
    reach = np.maximum.accumulate(end)
    keep = np.concatenate([[True], reach[:-1] < end[1:]])
    start, level = start[keep], level[keep]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rising = start[:0]
    for k in range(LEVELS + 1):
        here = np.unique(np.concatenate([start[level == k], rising]))
        even = (here >> k) & 1 == 0
        mate = np.isin(here + (1 << k), here, assume_unique=True) & even & (k < LEVELS)
        rising = here[mate]
        alone = ~(mate | np.isin(here - (1 << k), rising, assume_unique=True))
        done.append((here[alone], here[alone] + (1 << k)))
    s, e = (np.concatenate([d[i] for d in done]) for i in (0, 1))
    order = np.argsort(s)
    s, e = s[order], e[order]
    head = np.concatenate([[True], s[1:] != e[:-1]])
    tail = np.concatenate([head[1:], [True]])
    return s[head] // span, s[head] % span, (e[tail] - 1) % span + 1


def _runs(batches):
    for pdf in whole_groups(batches, ["key"]):
        codes, names = pd.factorize(pdf["key"], use_na_sentinel=False)
        k, lo, hi = merge_blocks(codes.astype("int64"), pdf["level"].to_numpy(dtype="int64"), pdf["idx"].to_numpy(dtype="int64"))
        names = np.asarray(names, dtype=object)
        yield pd.DataFrame({"key": names[k], "kind": "period", "lo": lo, "hi": hi})
        same = k[1:] == k[:-1]
        yield pd.DataFrame({"key": names[k[1:][same]], "kind": "gap", "lo": hi[:-1][same], "hi": lo[1:][same]})
