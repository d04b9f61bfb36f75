import datetime as dt
import random

from termloom.operators import intervals as I

ROWS = "key string, first_day date, last_day date, kind string"
DAY = dt.timedelta(1)


def brute(rows):
    out, by = set(), {}
    for k, a, b, _ in rows:
        if a is not None and (b is None or b >= a):
            by.setdefault(k, []).append((a, b or dt.date.max))
    for k, xs in by.items():
        runs = []
        for a, b in sorted(xs):
            if runs and (runs[-1][1] == dt.date.max or a <= runs[-1][1] + DAY):
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for i, (a, b) in enumerate(runs):
            out.add((k, "period", a, None if b == dt.date.max else b))
            if i:
                out.add((k, "gap", runs[i - 1][1] + DAY, a - DAY))
    return out


def check(spark, rows):
    got = {tuple(r) for r in I.periods_and_gaps(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    random.seed(3)
    base, rows = dt.date(1969, 12, 1), []
    for i in range(500):
        a = base + dt.timedelta(random.randrange(3000))
        b = None if i % 97 == 0 else a + dt.timedelta(random.randrange(-3, 40))
        rows.append((random.choice(["hot", "hot", "a", "b", None]), None if i % 41 == 0 else a, b, "x"))
    check(spark, rows)


def test_edges(spark):
    d = dt.date
    check(spark, [("a", d(2020, 1, 1), d(2020, 1, 1), ""), ("a", d(2020, 1, 2), d(2020, 1, 5), ""), ("a", d(2020, 1, 7), None, ""), ("b", d(1, 1, 1), d(1, 1, 3), ""), ("b", d(2000, 1, 1), d(9998, 12, 31), ""),
                  ("c", d(2020, 1, 5), d(2020, 1, 1), ""), ("e", d(2020, 1, 1), d(2020, 1, 3), ""), ("e", d(2020, 1, 1), d(2020, 1, 3), "")])
    check(spark, [])
