import datetime as dt

from termloom.operators import units as U

FEES = "fee_row_id bigint, code string, description string, units string, amount string, effective_start date, feed string"
FEEDS = "feed string, units_unit string, amount_unit string, duration_unit string"


def test_fees_of_undeclared_feeds_keep_their_units(spark):
    day = lambda i: dt.date(2020, 1, 1 + i)
    rows = [(i, "a", None, "40 MSU" if i < 5 else "40", None, day(i), "absent") for i in range(10)]
    rows += [(20, "b", None, "7", None, day(0), "null"), (30, "c", None, "3", None, day(0), "f")]
    fees = spark.createDataFrame(rows, FEES)
    feeds = spark.createDataFrame([("f", "msu", "cent", "minute"), ("null", None, None, None)], FEEDS)
    segmented = U.common(U.segment_units(U.measured(fees, spark.createDataFrame([], "record_id bigint, feed string, code string, fee_values map<string,string>, description array<string>"), feeds)))
    want = {r["row_id"]: r["common_value"] for r in segmented.collect()}
    got = {r["fee_row_id"]: r["units_common"] for r in U.with_common_units(fees, feeds).collect()}
    assert set(got) == set(range(10)) | {30}  # no value of code b declares a unit
    assert want.pop(20) is None and got == want and len({got[i] for i in range(10)}) == 1
