import random

from pyspark.sql import functions as F

from termloom.operators import tables as T


def test_carry_forward_against_a_loop(spark):
    random.seed(8)
    rows = [(i, random.choice(["hot", "hot", "hot", "b", None]), random.randrange(6), random.choice([None, None, "x", "y"]), random.choice([None, None, None, "z"]), 0) for i in range(300)]
    want, last = {}, {}
    for i, k, page, a, b, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        seen = last.setdefault(k, [None, None])
        seen[0], seen[1] = a or seen[0], b or seen[1]
        want[i] = tuple(seen)
    df = spark.createDataFrame(rows, "i int, k string, page int, a string, b string, _other int")
    got = T.carry_forward(df, ["k"], F.col("page"), [F.col("i")], ["a", "b"])
    assert {r["i"]: (r["a"], r["b"]) for r in got.collect()} == want
    assert T.carry_forward(df.limit(0), ["k"], F.col("page"), [F.col("i")], ["a", "b"]).count() == 0
