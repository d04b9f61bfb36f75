import datetime as dt

from pyspark.sql import functions as F

from termloom.operators import references as R

REFS = "tbl string, row_id bigint, key string, at date, period string, reason string"
PARENTS = "key string, valid_start date, valid_end date, tbl string"


def d(n):
    return None if n is None else dt.date(2020, 1, 1) + dt.timedelta(n)


def brute(refs, parents):
    known = {}
    for k, s, e, _ in parents:
        if k is not None:
            a, b = known.get(k, (s, e))
            known[k] = (None if a is None or s is None else min(a, s), None if b is None or e is None else max(b, e))
    out = set()
    for tbl, i, k, at, _, _ in refs:
        if k is None:
            continue
        if k not in known:
            out.add((tbl, i, "missing"))
        elif at is not None:
            s, e = known[k]
            if e is not None and e < at:
                out.add((tbl, i, "deleted"))
            elif s is not None and s > at:
                out.add((tbl, i, "later"))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    parents = [(f"k{i}", d(i % 7 - 3 if i % 5 else None), d(i % 9 + 2 if i % 4 else None), "x") for i in range(60)] + [("k1", None, d(1), "y"), (None, None, None, None)]
    refs = [("t", i, "k3" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 80}", d(i % 20 - 5 if i % 6 else None), "p", "clash") for i in range(900)]
    got = R.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), rows_per_salt=40, ranges=5)
    assert {(r["tbl"], r["row_id"], r["reason"]) for r in got.collect()} == brute(refs, parents)


def test_empty(spark):
    refs, none = spark.createDataFrame([("t", 1, "a", None, None, None)], REFS), spark.createDataFrame([], PARENTS)
    assert [r["reason"] for r in R.orphans(refs, none).collect()] == ["missing"]
    assert R.orphans(spark.createDataFrame([], REFS), none).count() == 0


def test_counts(spark):
    refs = spark.createDataFrame([("t", 1, "a", None, "2020", None), ("t", 2, "b", None, None, None)], REFS)
    got = R.counts(R.orphans(refs, spark.createDataFrame([("b", None, None, "")], PARENTS)), refs)
    assert {tuple(r) for r in got.collect()} == {("t", "2020", 1, 1, 0, 0), ("t", "none", 1, 0, 0, 0)}


def test_printed_key(spark):
    rows = [("A00.1-",), (" a0 01",), ("--",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "c string").select(R.printed_key(F.col("c"))).collect()] == ["a001", "a001", None, None, None]
