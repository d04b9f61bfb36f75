import datetime as dt
import random

from termloom.operators import history as H

ROWS = "entity string, at date, state string, received timestamp, row_id bigint, version int"


def brute(rows):
    out, by = set(), {}
    for e, at, s, rec, i, _ in rows:
        if at is not None:
            by.setdefault(e, {}).setdefault(at, []).append(((rec is not None, rec or dt.datetime.min, i), s))
    for e, days in by.items():
        runs = []
        for at in sorted(days):
            s = max(days[at], key=lambda x: x[0])[1]
            if not runs or runs[-1][1] != s:
                runs.append((at, s))
        for k, (at, s) in enumerate(runs):
            out.add((e, k + 1, at, runs[k + 1][0] if k + 1 < len(runs) else None, s))
    return out


def test_against_brute_force(spark):
    random.seed(2)
    base, now = dt.date(2020, 1, 1), dt.datetime(2020, 1, 1)
    rows = [(random.choice(["a", "b", "hot", "hot", None]), None if i % 50 == 0 else base + dt.timedelta(random.randrange(40)), random.choice(["x", "y", None]),
             None if i % 7 == 0 else now + dt.timedelta(random.randrange(5)), i, 9) for i in range(600)]
    got = {(r["entity"], r["version"], r["valid_from"], r["valid_to"], r["state"]) for r in H.versions(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert H.versions(spark.createDataFrame([], ROWS)).count() == 0
