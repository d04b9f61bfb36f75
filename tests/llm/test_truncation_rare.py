from termloom.llm import truncation as T

ROWS, COPIES = "tbl string, row_id bigint, source string, text string", "tbl string, text string"


def cut_rows(spark, texts, copies):
    rows = spark.createDataFrame([("t", i, "s", t) for i, t in enumerate(texts)], ROWS)
    return {texts[r["row_id"]] for r in T.found(rows, spark.createDataFrame([("c", t) for t in copies], COPIES)).collect()}


def test_open_word_after_a_rare_one(spark):
    whole = [f"finding{i % 25} and sign{i}" for i in range(120)]
    assert cut_rows(spark, ["stenosis of finger and", "stenosis of finger"], whole) == {"stenosis of finger and"}


def test_word_that_goes_on_after_few_others_may_end(spark):
    whole = [f"kind{i % 3} sore part{i}" for i in range(120)]
    assert cut_rows(spark, ["throat sore"], whole) == set()


def test_one_longer_copy_that_goes_on_inside_the_word(spark):
    texts = ["Deep malformat", "Deep wart", "Deep sacr", "Late malformat"]
    assert cut_rows(spark, texts, ["Deep malformation of knee", "Deep warts", "Deep sacrum", "Sacr of knee"]) == {"Deep malformat"}
