import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import quantity as Q
from termloom.operators import units as U

FEES = "fee_row_id bigint, code string, description string, units string, amount string, effective_start date, feed string, x int"
RECORDS = "record_id bigint, feed string, code string, description array<string>, fee_values map<string,string>"
FEEDS = "feed string, units_unit string, amount_unit string, duration_unit string"


def frames(spark, fees=(), records=(), feeds=(("f", "msu", "cent", "minute"), ("p", "point", "dollar", "hour"))):
    return spark.createDataFrame(list(fees), FEES), spark.createDataFrame(list(records), RECORDS), spark.createDataFrame(list(feeds), FEEDS)


@pytest.mark.parametrize("text,number", [("1,200", 1200), ("25,85 $", 25.85), ("1,792.15", 1792.15), ("56.50+MU", 56.5), ("50%", None), ("BR", None), ("", None), ("-", None),
                                         ("12.875 x $100", 12.875), ("1h15", 75), ("$1.1203k", 1.1203), (".5", 0.5), ("599,950 c", 599950), (None, None), ("1,234,50", 1234.5)])
def test_number(spark, text, number):
    got = spark.createDataFrame([(text,)], "v string").select(Q.number(F.col("v"))).first()[0]
    assert (got is None) == (number is None) and (number is None or math.isclose(float(got), number))


@pytest.mark.parametrize("q,text,unit", [("units", "98.50 MSU", "msu"), ("units", "68,500 milli-MSU", "milli_msu"), ("units", "240 Pt.", "point"), ("units", "1.20RVUs", "rvu"), ("units", "56+MU", None),
                                         ("amount", "CAD 5,997.5", "dollar"), ("amount", "5315 ct.", "cent"), ("amount", "1,075¢", "cent"), ("amount", "12.875 x $100", "hundred_dollars"),
                                         ("amount", "6.0005 k$", "thousand_dollars"), ("duration", "0.25 hour(s)", "hour"), ("duration", "6 t.u.", "time_unit"), ("duration", "45+T", None)])
def test_unit_in_value(spark, q, text, unit):
    assert spark.createDataFrame([(text,)], "v string").select(Q.unit_in_value(F.col("v"), q)).first()[0] == unit


def test_found(spark):
    day = dt.date(2020, 1, 1)
    fees = [(1, "a", None, "40", "1200", day, "f", 0), (2, "a", "Repair (values in points)", "40", "$12", None, "f", 0), (3, "a", "x", "40", None, day, "p", 0), (4, None, None, "50%", "n/a", day, "f", 0),
            (5, "a", None, "2 rvu", None, day, None, 0), (5, "a", None, "2 rvu", None, day, None, 0)]
    records = [(7, "p", "a", ["Time", "(MSU)"], {"units": "3", "duration": "2", "amount": "5"}), (8, "f", "a", None, None), (9, "f", "a", [], {"duration": "1h15"}), (10, "f", "a", [], {})]
    got = {tuple(r) for r in U.recorded_otherwise(U.segment_units(U.measured(*frames(spark, fees, records)))).collect()}
    assert got == {("ns_msi_sample", 1, "amount", 1200), ("ns_msi_sample", 2, "units", 200), ("ns_msi_sample", 3, "units", 200), ("ns_msi_sample", 5, "units", 500),
                   ("fee_record", 7, "duration", 12000), ("fee_record", 9, "duration", 7500)}


def test_empty(spark):
    assert U.recorded_otherwise(U.segment_units(U.measured(*frames(spark, feeds=())))).count() == 0


def test_undeclared_values_take_the_unit_of_their_level(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(d) for d in range(12)]
    fees = [(i, "a", None, str(40 if i < 4 or i > 8 else 800), None, d, "u", 0) for i, d in enumerate(days)] + [(50 + i, "a", None, "40 MSU", None, d, "f", 0) for i, d in enumerate(days)]
    seg = U.segment_units(U.measured(*frames(spark, fees))).filter("feed = 'u'").orderBy("row_id").collect()
    assert [r["unit"] for r in seg] == ["msu"] * 4 + ["point"] * 5 + ["msu"] * 3
    assert [r["row_id"] for r in seg if r["changed"]] == [4, 9]


def cost_of(costs, path):
    return sum(c[u] for c, u in zip(costs, path)) + U.PENALTY * sum(a != b for a, b in zip(path, path[1:]))


def test_search_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        costs = rng.uniform(0, 9, (5, U.STATES))
        best = min(cost_of(costs, p) for p in itertools.product(range(U.STATES), repeat=5))
        none = np.zeros((1, U.STATES))
        assert math.isclose(cost_of(costs, U._solve(costs, np.array([0]), np.array([5]), none, none)), best)


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    start = dt.date(2000, 1, 1)
    fees = [(i, "hot", None, str(round(40 * (20 if (i // 37) % 3 == 1 else 1) * float(rng.uniform(0.9, 1.1)), 2)), None, start + dt.timedelta(i), "u", 0) for i in range(400)]
    fees += [(1000 + i, "hot", None, "40 MSU", None, start + dt.timedelta(i), "f", 0) for i in range(50)]
    m = U.measured(*frames(spark, fees))
    one, many, joined = ({(r["row_id"], r["unit"], r["changed"]) for r in U.segment_units(m, n, k).collect()} for n, k in ((1, 100), (7, 100), (7, 0)))
    assert one == many == joined and {u for _, u, _ in one} == {"msu", "point"}


def test_codes_without_a_declared_value_get_no_unit(spark):
    day = dt.date(2020, 1, 1)
    fees = [(i, "lone", None, "40", None, day + dt.timedelta(i), "u", 0) for i in range(4)] + [(9, "b", None, "0", None, day, "u", 0), (10, "b", None, "7 pts", None, day, "u", 0)]
    seg = U.segment_units(U.measured(*frames(spark, fees)))
    assert {r["row_id"]: (r["unit"], r["changed"]) for r in seg.collect() if r["row_id"] < 9} == {i: (None, False) for i in range(4)}
    assert {tuple(r) for r in U.recorded_otherwise(seg).collect()} == {("ns_msi_sample", 9, "units", 0), ("ns_msi_sample", 10, "units", 35)}


def test_hidden_units_come_back_from_levels(spark):
    rng, start = np.random.default_rng(4), dt.date(2010, 1, 1)
    fees, i = [], 0
    for c in range(12):
        for feed in range(6):
            for k in range(30):
                point = (k // 10 + feed) % 2
                fees.append((i, f"c{c}", None, f"{(5 + 9 * c) * (20 if point else 1) * float(rng.uniform(0.9, 1.1)):.2f} {'pts' if point else 'MSU'}", None, start + dt.timedelta(k), f"feed{feed}", 0))
                i += 1
    got = U.recovered(U.segment_units(U.blinded(U.measured(*frames(spark, fees))))).first()
    assert got["n_hidden"] > 100 and got["n_given"] == got["n_hidden"] and got["n_right"] >= 0.9 * got["n_hidden"]
