"""Values cut off by field limits, by a self-join on prefixes.

First the values themselves: a value is met with all longer values that it begins. Both are known by the digest of what
stands before a word (``head``); a longer value goes on inside the last word of the shorter one if, after the same head,
it has a longer word that this word begins. Such a copy settles a value (``copy``).

Only values without such a copy are tried by their tail, the last two words, which is met with the word pairs of all
values in the same way:

* the last word is a strict prefix of longer words that follow the same word elsewhere (``with ro`` / ``with routine``);
* the last two words go on in other values, always without a break (``with fever`` / ``with fever and``): a phrase
  that may end is followed by punctuation or by nothing at least now and then. A word that goes on after many other
  words and hardly ever breaks or ends (``and``, ``by``) leaves any value open, however rare its pair.

What is left are values that stop at an open bracket or a separator (``open mark``).

The words of each distinct value are taken once. Pairs and prefixes are counted with map-side combination before they
move, so a value that makes up a third of the rows is one row after the first aggregation; the rows get the verdict of
their value by a join that splits hot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import ROWS_PER_SALT, cut, join_hot

#: A word with inner hyphens and apostrophes, then what separates it from the next.
WORD = r"[\p{L}\p{N}%$¢]+(?:[-'’][\p{L}\p{N}]+)*"
MARKS = r"(\.\.\.|…|�)\s*$"
LEAST = 3        # longer copies that a tail must have
OPEN_SHARE = 0.02  # share of breaks after a phrase below which it is open
END_SHARE = 0.35   # ends against continuations of an open phrase, at most
SURE = 20  # breaks that a word's usual share would have given after a phrase that has none
WORD_LEAST, WORD_AFTER = 100, 20  # continuations of a word that settles a tail alone, and the words it follows in them
WORD_BREAK, WORD_END = 0.001, 0.05  # its breaks and ends against its continuations, at most
WORD_RATIO = 8   # longer words against uses of the same letters as a word
BY = ["copy", "tail", "open mark"]


def stem(text: Column) -> Column:
    """The value without marks of a cut and blanks at its end."""
    return F.rtrim(F.regexp_replace(text, MARKS, ""))


def _words(text: Column) -> Column:
    """array<struct<w, sep>>: the words in lower case, each with the text up to the next word."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})([^\\p{{L}}\\p{{N}}%$¢]*)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(
        F.lower(F.regexp_extract(x, f"^({WORD})", 1)).alias("w"), F.regexp_replace(x, f"^{WORD}", "").alias("sep")))


def values_of(texts: DataFrame) -> DataFrame:
    """vid, stem, marked, ws for texts(tbl, text): the distinct values of each table, case aside, that have a word."""
    values = texts.filter(F.col("text").isNotNull()).groupBy("tbl", "text").agg(F.lit(1).alias("one"))
    values = values.select("tbl", stem(F.col("text")).alias("stem"), F.col("text").rlike(MARKS).alias("marked"))
    values = values.groupBy("tbl", F.lower("stem").alias("fold")).agg(F.max("stem").alias("stem"), F.min("marked").alias("marked"))
    return values.select(vid_of(F.col("stem")).alias("vid"), "stem", "marked", _words(F.col("stem")).alias("ws")).filter(F.size("ws") > 0)


def vid_of(stem_: Column) -> Column:
    return F.md5(F.lower(stem_))


def _head(words: Column, n: Column) -> Column:
    """What stands before the word after the first ``n``, as a digest."""
    return F.md5(F.concat_ws("", F.transform(F.slice(words, F.lit(1), n), lambda x: F.concat(x["w"], x["sep"]))))


def copies(values: DataFrame) -> DataFrame:
    """vid: whole values of which a longer copy goes on inside the last word, unless that is a word used within other
    values or the copy has its plural."""
    ws = values.filter(~F.col("marked")).select("ws")
    each = ws.select(F.explode(F.transform("ws", lambda x, i: F.struct(_head(F.col("ws"), i).alias("head"), x["w"].alias("word"), (i == F.size("ws") - 1).alias("last")))).alias("p")).select("p.*")
    each = each.groupBy("head", "word").agg(F.max("last").alias("last"), F.max(~F.col("last")).alias("within"))
    within = each.filter("within").select("word").distinct()
    ends = values.select("vid", _head(F.col("ws"), F.size("ws") - 1).alias("head"), F.element_at("ws", -1)["w"].alias("word")).join(within, "word", "left_anti")
    longer = each.filter(F.length("word") > 1).join(ends.select("head").distinct(), "head", "left_semi").select("head", F.col("word").alias("long"))
    longer = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("long") - 1))).select("head", F.expr("substring(long, 1, k)").alias("word"), F.expr("substring(long, k + 1)").alias("rest"))
    longer = longer.filter(F.col("rest").rlike(r"^[\p{L}\p{N}]") & ~F.col("rest").isin("s", "es"))
    return ends.join(longer.select("head", "word").distinct(), ["head", "word"], "left_semi").select("vid").distinct()


def _pairs(values: DataFrame) -> DataFrame:
    """prev, word, how, marked, n: the pairs of words of all values and how each goes on."""
    pair = F.transform("ws", lambda x, i: F.struct(
        F.when(i > 0, F.element_at("ws", F.greatest(i, F.lit(1)))["w"]).otherwise(F.lit("^")).alias("prev"),
        x["w"].alias("word"), x["sep"].alias("sep"), (i == F.size("ws") - 1).alias("last")))
    flat = values.select("marked", F.explode(pair).alias("p")).select("marked", "p.*")
    return flat.groupBy("prev", "word", F.when(F.col("last"), F.lit("end")).when(F.col("sep").rlike(r"^\s+$"), F.lit("go")).otherwise(F.lit("break")).alias("how"),
                        (F.col("last") & F.col("marked")).alias("marked")).agg(F.count(F.lit(1)).alias("n"))


def tails(values: DataFrame) -> DataFrame:
    """prev, word, cut, cut_if_marked: for every tail of a value whether it was cut there (without a mark, and with one)."""
    pairs = _pairs(values).withColumn("n", F.when(F.col("marked"), 0).otherwise(F.col("n")))
    stats = cut(pairs.groupBy("prev", "word").agg(*[F.sum(F.when(F.col("how") == h, F.col("n")).otherwise(0)).alias(h) for h in ("go", "break", "end")],
                                                  F.max(F.col("how") == "end").alias("is_tail")))
    longer = _longer(stats.select("prev", "word", (F.col("go") + F.col("break") + F.col("end")).alias("uses")), ["prev"], "longer_uses")
    alone = cut(stats.groupBy("word").agg(*[F.sum(c).alias(f"w_{c}") for c in ("go", "break", "end")], F.count(F.when(F.col("go") > 0, 1)).alias("w_after")))
    anywhere = _longer(alone.select("word", (F.col("w_go") + F.col("w_break") + F.col("w_end")).alias("uses")), [], "any_longer")
    by_word = alone.join(anywhere, "word", "left")
    t = stats.filter("is_tail").join(longer, ["prev", "word"], "left").join(by_word, "word", "left").fillna(0)
    go, brk, end = F.col("go"), F.col("break"), F.col("end")
    w_go, w_brk, w_end = F.col("w_go"), F.col("w_break"), F.col("w_end")
    long_, any_ = F.col("longer_uses"), F.col("any_longer")
    mid = (long_ >= LEAST) & (long_ >= WORD_RATIO * (go + brk + 1)) & (w_go + w_brk + w_end / 4 < long_)
    mid = mid | ((any_ >= LEAST) & (any_ >= WORD_RATIO * (w_go + w_brk + w_end + 1)))
    ends = (w_brk + w_end) / (w_go + w_brk + w_end)
    never = (w_brk <= OPEN_SHARE * w_go) | (go * ends >= SURE)
    open_ = (go >= LEAST) & (brk <= OPEN_SHARE * go) & (end <= END_SHARE * go) & never
    alone_open = (w_go >= WORD_LEAST) & (F.col("w_after") >= WORD_AFTER) & (w_brk <= WORD_BREAK * w_go) & (w_end <= WORD_END * w_go) & (brk == 0)
    open_ = open_ | alone_open
    return t.select("prev", "word", (mid | open_).alias("cut"), (mid | open_ | (long_ >= 1) | (any_ > w_go + w_brk)).alias("cut_if_marked"))


def _longer(words: DataFrame, by: list[str], name: str) -> DataFrame:
    """For every strict prefix of a word: the uses of the words it begins."""
    cut_ = words.filter(F.length("word") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    return cut_.groupBy(*by, F.expr("substring(word, 1, k)").alias("word")).agg(F.sum("uses").alias(name))


def verdicts(values: DataFrame) -> DataFrame:
    """vid, by_copy, cut, cut_if_marked, shut, abbreviation, open_mark: what is known of each distinct value."""
    n, last = F.size("ws"), F.element_at("ws", -1)
    v = values.select("vid", "stem", n.alias("n"), F.when(n > 1, F.element_at("ws", F.greatest(n - 1, F.lit(1)))["w"]).otherwise(F.lit("^")).alias("prev"), last["w"].alias("word"), last["sep"].alias("tail"))
    v = v.join(copies(values).withColumn("by_copy", F.lit(True)), "vid", "left").join(tails(values), ["prev", "word"], "left")
    none = F.lit(False)
    return v.groupBy("vid").agg(F.max(F.coalesce("by_copy", none)).alias("by_copy"), F.max(F.coalesce("cut", none)).alias("cut"), F.max(F.coalesce("cut_if_marked", none)).alias("cut_if_marked"),
                                F.max(F.col("tail").rlike(r"[)\].\"!?]")).alias("shut"), F.max("n").alias("n"), F.max(F.col("stem").rlike(r"[(\[][^)\]]*$|[,;(\[]\s*$|\s[-–]$")).alias("open_mark"))


def found(rows: DataFrame, others: DataFrame, per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Rows (tbl, row_id, source, text) whose text was cut, with ``by`` (copy, tail or open mark); others (tbl, text) may
    hold further whole copies.

    Null, empty and wordless texts are no case. A text that ends in a bracket, a full stop or another closing mark is
    complete, as is a single word in capitals (an abbreviation). Repeated rows are judged alike. Empty inputs give an
    empty result."""
    values = cut(values_of(rows.select("tbl", "text").unionByName(others.select("tbl", "text"))))
    v = cut(verdicts(values))
    rows = rows.filter(F.col("text").isNotNull()).withColumn("stem", stem(F.col("text"))).withColumn("marked", F.col("text").rlike(MARKS))
    rows = rows.select("tbl", "row_id", "source", "stem", "marked", vid_of(F.col("stem")).alias("vid"))
    out = join_hot(rows, v, ["vid"], per_salt).filter(F.col("n").isNotNull())
    abbreviation = (F.col("n") == 1) & F.col("stem").rlike(r"^[^\p{Ll}\s]{1,10}$") & ~F.col("marked")
    tail = F.when(F.col("marked"), F.col("cut_if_marked")).otherwise(F.col("cut"))
    by = F.when(F.col("by_copy"), BY[0]).when(tail, BY[1]).when(F.col("open_mark"), BY[2])
    return out.filter(~F.col("shut") & ~abbreviation).withColumn("by", by).filter("by is not null").select("tbl", "row_id", "source", "by")


def rates(found_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Per table and source: rows with a text, cut ones, their share, and how many a whole copy settled."""
    key = lambda: (F.col("tbl"), F.coalesce("source", F.lit("none")).alias("source"))
    total = rows.filter(F.col("text").isNotNull()).groupBy(*key()).agg(F.count(F.lit(1)).alias("n_rows"))
    bad = found_rows.groupBy(F.col("tbl").alias("t_"), F.coalesce("source", F.lit("none")).alias("s_")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("by") == "copy").cast("bigint")).alias("c"))
    out = total.join(bad, (F.col("tbl") == F.col("t_")) & (F.col("source") == F.col("s_")), "left").withColumn("n_cut", F.coalesce("n", F.lit(0)).cast("bigint"))
    return out.select("tbl", "source", "n_rows", "n_cut", F.round(F.col("n_cut") / F.col("n_rows"), 6).alias("cut_share"), F.coalesce("c", F.lit(0)).cast("bigint").alias("n_by_copy"))
