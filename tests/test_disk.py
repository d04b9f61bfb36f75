"""What annotation writes to disk: rows of numbers, not the tables they point to."""

import random
import time

from pyspark.sql import functions as F

from termloom.operators import annotate as A
from termloom.operators import packed
from termloom.plans import catalogue as Q


def shuffled(spark, run) -> tuple[list, float]:
    """Rows of ``run()`` and the MB of shuffles written for them."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = total()
    rows = run().collect()
    return rows, (total() - before) / 1e6


def test_senses_of_a_mention_are_not_shuffled(spark):
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(10)]
    docs = spark.createDataFrame([(d, " ".join(["ms", *words[:40], "ms"])) for d in range(200)], "doc_id bigint, text string")
    found = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(41))).alias("i"), F.lit(1).alias("n"), F.lit("ms").alias("text"))
    # 300 senses with 20 cues, of which sense t has min(20, 40 - t) in the texts, at least none
    senses = spark.createDataFrame([("ms", f"t{t}", words[(t + c) % 200]) for t in range(300) for c in range(20)], "term string, target string, cue string")
    rows, mb = shuffled(spark, lambda: A.sense_hits(found, docs, senses))
    want = {f"t{t}": n for t in range(300) if (n := sum((t + c) % 200 < 40 for c in range(20)))}
    assert len(rows) == 400 * len(want) and {(r["target"], r["n_cues"]) for r in rows} == set(want.items()) and not any(r["settled"] for r in rows)
    assert mb < 2, mb


def test_cues_of_senses_over_several_places_and_texts(spark):
    """A cue counts by any of its places, over punctuation, also where a document has several texts."""
    docs = spark.createDataFrame([(1, "leg ms leg, weakness"), (2, "ms"), (2, "no heart"), (3, "leg weakness"), (4, None), (5, "½ ms")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, 0, 2, "MS"), (1, 2, 1, "ms"), (2, 0, 1, "ms"), (3, 0, 1, "ms"), (5, 1, 1, "ms")], "doc_id bigint, i int, n int, text string")
    senses = spark.createDataFrame([("ms", "a", "leg weakness"), ("ms", "a", "leg"), ("ms", "b", "heart"), ("ms", "b", "Heart"), ("ms", "b", "weakness"), ("ms", "c", "1 2"), (None, "d", "leg")], "term string, target string, cue string")
    got = {tuple(r) for r in A.sense_hits(found, docs, senses).collect()}
    assert got == {(1, 0, "a", 2, True), (1, 0, "b", 1, False), (1, 2, "a", 1, False), (1, 2, "b", 1, False), (2, 0, "b", 1, True), (3, 0, "b", 1, True), (5, 1, "c", 1, True)}


def test_unpacked_texts_are_shuffled_once(spark):
    long = " ".join(f"word{k}" for k in range(400))
    rows = spark.range(200).select(F.lit("t").alias("tbl"), F.col("id").alias("row_id"), F.lit("f").alias("field"), F.concat(F.col("id").cast("string"), F.lit(f" {long}; b, c | d")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] / 1e6
    got, mb = shuffled(spark, lambda: packed.unpack(rows).groupBy("row_id").agg(F.count("item").alias("n")))
    assert len(got) == 200 and {r["n"] for r in got} == {2}
    assert mb < 3 * size, (mb, size)


def test_mentions_are_shuffled_without_what_they_stand_for(spark, tmp_path):
    words = [f"{a}{b}itis" for a in ("arn", "bol", "cam", "dor") for b in ("ab", "ec", "id", "of", "ug")]
    rng = random.Random(7)
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2000))
    concepts = [(k * 10 + c, "UMLS", f"C{k}{c}", f"{w} kind {c}", "condition", None, None, None) for k, w in enumerate(words) for c in range(5)]
    rows = {"concept": (concepts, "concept_id bigint, vocabulary_id string, code string, name string, domain string, concept_class string, is_billable boolean, valid_end date"),
            "concept_synonym": ([(c[0], f"{words[c[0] // 10]} ({noise()})", "preferred", "UMLS") for c in concepts], "concept_id bigint, term string, term_type string, source string"),
            "concept_relationship": ([], "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, confidence double, source string"),
            "patterns": ([(1, "sore toe", words[0])], "pattern_id bigint, pattern string, targets string"), "senses": ([(1, words[1], words[2], "pulse")], "sense_id bigint, term string, target string, cues string"),
            "documents": ([(d, "No " + ". ".join(words) + ". Sore toe, pulse 60.") for d in range(100)], "doc_id bigint, text string")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got, mb = shuffled(spark, lambda: Q.q_annotations(spark, str(tmp_path)))
    want = {w: (k * 10, "negated" if k == 0 else None) for k, w in enumerate(words)} | {"Sore toe": (0, None)}
    assert len(got) == 2100 and {r["text"]: (r["concept_id"], r["assertion"]) for r in got} == want
    assert mb < 3, mb
