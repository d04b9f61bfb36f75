"""Several values in one field: the dialect of least description length, then its parse.

A dialect is a set of separators and a set of quote characters. Candidates for a field are all subsets of the
separators that occur in it, with each quoting that makes a difference. The description length of a parse is the code
length of its values, plus a price per separator: a value costs -log2 of its share among all values of fields of its
kind, and its part of the list of values, which spells each value once however often it is used. At first every
candidate of a field counts alike, so no dialect is favoured; then each field takes its cheapest dialect and the shares
are counted again. The counts are those of all rows, made by distributed aggregation and met by joins. What is special
to a kind of field is a ``Rule``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import ROWS_PER_SALT, cut, join_hot, maybe_broadcast, width

SEPARATORS = ("\n", "\t", ";", "|", ",", " / ")
QUOTES = ('"\'', '"', "'", "")
CHAR_BITS, ITEM_BITS, SEPARATOR_BITS, QUOTE_BITS = 7.0, 4.0, 2.0, 1.0
EDGE_BITS = 16.0  # of a quote left standing at either end of a value, each time: quotes there should enclose it
INSIDE_BITS = 30.0  # of a separator within a value, in the list of values: more than another value would cost
CHOSEN_ROWS = 1_000_000  # pairs of two numbers that are broadcast at most
ROUNDS = 2  # choices of a dialect, each with the shares of the one before


@dataclass(frozen=True)
class Rule:
    """What is special to a kind of field: its separators, whether square brackets keep what stands in them together,
    and whether brackets around the whole field are taken off."""

    separators: tuple[str, ...] = SEPARATORS
    keep_brackets: bool = False
    unwrap: bool = False


PLAIN = Rule()


def split_items(text: str, separators: tuple[str, ...], quotes: str, keep_brackets: bool = False, enclosed: list[str] | None = None) -> list[str]:
    """Items of ``text``: trimmed, unquoted, without empty ones. A quote opens only at the start of an item and must
    close before a separator or the end, else it is part of the text; a doubled quote inside is one quote. With
    ``keep_brackets`` nothing is split inside square brackets. A slash separates only between blanks. Values that were
    enclosed in quotes are also added to ``enclosed``."""
    out, i, n, last = [], 0, len(text), text.rfind("]")
    single = frozenset(s for s in separators if len(s) == 1)
    slash = " / " in separators

    def at_separator(j: int) -> int:
        c = text[j]
        if c in single:
            return 1
        return int(slash and c == "/" and (j == 0 or text[j - 1].isspace()) and (j + 1 == n or text[j + 1].isspace()))

    while i <= n:
        while i < n and text[i].isspace() and not at_separator(i):
            i += 1
        item = None
        if i < n and text[i] in quotes:
            q, j, buf = text[i], i + 1, []
            while j < n:
                if text[j] == q:
                    if j + 1 < n and text[j + 1] == q:
                        buf.append(q)
                        j += 2
                        continue
                    break
                buf.append(text[j])
                j += 1
            k = j + 1
            while k < n and text[k].isspace() and not at_separator(k):
                k += 1
            if j < n and (k >= n or at_separator(k)):
                item, i = "".join(buf).strip(), k
                if enclosed is not None:
                    enclosed.append(q + item)
        if item is None:
            j, depth = i, 0
            while j < n:
                if keep_brackets and text[j] == "[" and j < last:
                    depth += 1
                elif keep_brackets and text[j] == "]" and depth:
                    depth -= 1
                if not depth and at_separator(j):
                    break
                j += 1
            item, i = text[i:j].strip(), j
        if item:
            out.append(item)
        if i >= n:
            break
        i += 1
    return out


def unwrap(text: str) -> str:
    """Without brackets around the whole list."""
    t = text.strip()
    pairs = {"[": "]", "(": ")", "{": "}", "<": ">"}
    if len(t) >= 2 and pairs.get(t[0]) == t[-1]:
        depth = 0
        for i, c in enumerate(t):
            depth += (c == t[0]) - (c == t[-1])
            if depth == 0 and i < len(t) - 1:
                return t
        return t[1:-1]
    return t


def candidates(text: str, rule: Rule = PLAIN) -> list[tuple[list[str], float]]:
    """Different parses with the price of their dialect, the finest first. A dialect that takes a quote for a letter pays
    for the values which that quote encloses."""
    if rule.unwrap:
        text = unwrap(text)
    there = [s for s in rule.separators if s in text or (s == " / " and "/" in text)]
    seen, out = set(), []
    for size in range(len(there), -1, -1):
        for seps in combinations(there, size):
            held: list[str] = []
            for quotes in QUOTES:
                if any(q not in text for q in quotes):
                    continue
                items = split_items(text, seps, quotes, rule.keep_brackets, held if not held else None)
                if tuple(items) not in seen:
                    seen.add(tuple(items))
                    passed_over = sum(ITEM_BITS + CHAR_BITS * len(v) + EDGE_BITS for v in held if v[0] not in quotes)
                    out.append((items, size * SEPARATOR_BITS + len(quotes) * QUOTE_BITS + passed_over))
    return out


def _inside(rules: dict[str, Rule]) -> Column:
    """Separators that stand within an item."""
    single = lambda rule: F.length("item") - F.length(F.translate("item", "".join(s for s in rule.separators if len(s) == 1), ""))
    count = lambda rule: single(rule) + F.regexp_count("item", F.lit(r"\s/\s" if " / " in rule.separators else r"[^\s\S]"))
    out = count(PLAIN)
    for field, rule in rules.items():
        out = F.when(F.col("field") == field, count(rule)).otherwise(out)
    return out.cast("double")


def _chosen(parses: DataFrame, weight: str, rules: dict[str, Rule]) -> DataFrame:
    """tid, parse: the cheapest candidate of each text, by the items of all candidates with ``weight``."""
    counts = parses.select("field", F.explode("items").alias("item"), F.col(weight).alias("n")).groupBy("field", "item").agg(F.sum("n").alias("c")).filter("c > 0")
    total = counts.groupBy("field").agg(F.sum("c").alias("t"))  # a row per kind of field
    bits = counts.join(F.broadcast(total), "field").select("field", "item", "c", "t")
    open_ = parses.filter("n_parses > 1")
    items = open_.select("field", "tid", "parse", "price", F.explode_outer("items").alias("item")).join(maybe_broadcast(bits.drop("t")), ["field", "item"], "left").join(F.broadcast(total), "field", "left")
    uses = F.greatest(F.coalesce("c", F.lit(1.0)), F.lit(1.0))
    spelled = (F.lit(ITEM_BITS) + F.lit(CHAR_BITS) * F.length("item") + F.lit(INSIDE_BITS) * _inside(rules)) / uses
    edges = F.lit(EDGE_BITS) * (F.col("item").rlike("^[\"']").cast("double") + F.col("item").rlike("[\"']$").cast("double"))
    spelled = spelled + edges
    cost = items.groupBy("tid", "parse").agg((F.first("price") + F.sum(F.coalesce(F.log2(F.greatest(F.col("t"), F.lit(1.0)) / uses) + spelled, F.lit(0.0)))).alias("cost"))
    best = cost.groupBy("tid").agg(F.min_by("parse", F.struct(F.round("cost", 6), "parse")).alias("parse"))
    return best.unionByName(parses.filter("n_parses = 1").select("tid", "parse"))


def unpack(rows: DataFrame, rules: dict[str, Rule] | None = None, per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """rows: tbl, row_id, field, text; rules: by field. Gives tbl, row_id, field, item_pos, item.

    Parses are made once per distinct text and are known by a number after that. A null, empty or blank text gives no row; equal costs go to the finer
    parse; repeated items keep their own positions; a field that is one quoted value is that value. The candidates of a
    text are at most 2**6 separator sets times four quotings, usually two to eight. An empty input gives an empty result."""
    rules, spark = rules or {}, rows.sparkSession

    def run(batches):
        for pdf in batches:
            got = []
            for tid, kind, text, n in zip(pdf["tid"], pdf["field"], pdf["text"], pdf["n"]):
                many = candidates(text, rules.get(kind, PLAIN))
                got += [(tid, kind, text if k == 0 else None, k, len(many), price, items, float(n), n / len(many)) for k, (items, price) in enumerate(many)]
            yield pd.DataFrame(got, columns=["tid", "field", "text", "parse", "n_parses", "price", "items", "n", "share"])

    rows = rows.filter(F.trim("text") != "")
    texts = rows.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")).repartition(max(width(spark), spark.sparkContext.defaultParallelism))
    parses = cut(texts.withColumn("tid", F.monotonically_increasing_id()).mapInPandas(run, "tid bigint, field string, text string, parse int, n_parses int, price double, items array<string>, n double, share double"))
    named, chosen, weight = parses.drop("text"), None, "share"
    taken = lambda: maybe_broadcast(chosen, CHOSEN_ROWS)
    for k in range(ROUNDS):
        best = cut(_chosen(named if k == 0 else named.join(taken().withColumn("on", F.lit(1.0)), ["tid", "parse"], "left").withColumn("now", F.coalesce("on", F.lit(0.0)) * F.col("n")).drop("on"), weight, rules))
        chosen, weight = best, "now"
    items = parses.select("tid", "parse", "items").join(taken(), ["tid", "parse"], "left_semi").select("tid", "items")
    items = parses.filter("parse = 0").select("tid", "field", "text").join(items, "tid").select("field", "text", "items")
    out = join_hot(rows.select("field", "text", "tbl", "row_id"), items, ["field", "text"], per_salt)
    return out.select("tbl", "row_id", "field", F.posexplode("items").alias("p", "item")).select("tbl", "row_id", "field", (F.col("p") + 1).cast("int").alias("item_pos"), "item")


__all__ = ["Rule", "candidates", "split_items", "unpack", "unwrap"]
