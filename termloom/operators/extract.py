"""Records out of positioned text: words to lines, columns, assembly of fee records, code lists and bulletins.

Order inside a document is carried by windows over its lines: what starts a record or a heading is numbered by a
running sum, headings and sections are carried forward, and the lines of a record are gathered by its number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "struct<x0:double,x1:double,text:string>"


@dataclass
class Layout:
    """Where things stand on a page: regular expressions and x positions."""

    record: str                       # begins a record; its group names the code
    columns: dict[str, tuple[float, float]] = field(default_factory=dict)
    record_max_x: float = 1e9
    heading: str | None = None
    heading_max_x: float = 1e9
    page_section: str | None = None   # its group names the section
    modifier: str | None = None       # a token that begins a modifier line
    skip: tuple[str, ...] = ()
    leader: str = r"\.{2,}$"
    value: str = r"\$?\s*[\d,]+(?:\.\d+)?.*|Time Only|BR|IC"


def words_to_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """words: doc_id, page, top, x0, x1, text. Gives doc_id, page, line_no, top, words (left to right).

    A word begins a new line if it stands more than ``gap`` below the first word of the line so far: the tops of a page
    are folded in order, so a slowly drifting line is cut where a chain of small gaps would not cut it."""
    tops = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    fold = F.aggregate("tops", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > gap), F.concat(a, F.array(t))).otherwise(a))
    starts = tops.select("doc_id", "page", fold.alias("starts"))
    j = words.join(starts, ["doc_id", "page"])
    top = F.array_max(F.filter("starts", lambda s: s <= F.col("top")))
    j = j.select("doc_id", "page", top.alias("line_top"), F.struct("x0", "x1", "text").alias("w"))
    out = j.groupBy("doc_id", "page", "line_top").agg(F.array_sort(F.collect_list("w")).alias("words"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_top"))
    return out.select("doc_id", "page", n.alias("line_no"), F.col("line_top").alias("top"), "words")


def _between(a: float, b: float) -> Column:
    return F.filter("_ws", lambda w: w["x0"].between(a, b))


def _joined(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: w["text"]), " ")


def columns_of(lines: DataFrame, layout: Layout) -> DataFrame:
    """Adds text (left of the value columns), values (map by column), x0. Dot leaders are taken off; without one, words
    in the value columns are prose unless each reads as a value."""
    ws = F.transform("words", lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), F.regexp_replace(w["text"], layout.leader, "").alias("text"), w["text"].rlike(layout.leader).alias("led")))
    df = lines.withColumn("_ws", F.filter(ws, lambda w: w["text"] != "")).withColumn("_led", F.exists(ws, lambda w: w["led"])).withColumn("x0", F.coalesce(F.try_element_at("words", F.lit(1))["x0"], F.lit(0.0)))
    if not layout.columns:
        return df.withColumn("text", _joined(F.col("_ws"))).withColumn("values", F.create_map().cast("map<string,string>")).drop("_ws", "_led")
    low = min(a for a, _ in layout.columns.values())
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), _joined(_between(a, b)).alias("value")) for c, (a, b) in layout.columns.items()])
    df = df.withColumn("_v", F.filter(pairs, lambda p: p["value"] != ""))
    good = F.col("_led") | F.forall("_v", lambda p: p["value"].rlike(f"^(?:{layout.value})$"))
    inside = lambda w: F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in layout.columns.values()]), lambda r: w["x0"].between(r["a"], r["b"]))
    left = _joined(F.filter("_ws", lambda w: (w["x0"] < low) | ~inside(w)))
    return df.withColumn("text", F.when(good, left).otherwise(_joined(F.col("_ws")))).withColumn("values", F.when(good, F.map_from_entries("_v")).otherwise(F.create_map().cast("map<string,string>"))).drop("_ws", "_led", "_v")


def records(lines: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, records without a value, leftover lines). records: doc_id, record_no, code, page, section, heading,
    modifier, description, values.

    A record has a row for its own values and one per modifier line with values; one with no value at all is in the
    second result, with its description; lines below it and to its right go on
    with its description or, after a modifier, with that modifier. Lines before any record, and lines as far left as a
    record that begin none, are left over."""
    df = columns_of(lines, layout)
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    skip = F.lit(False)
    for p in (*layout.skip, *([layout.page_section] if layout.page_section else [])):
        skip = skip | F.col("raw").rlike(p)
    df = df.withColumn("raw", _joined(F.col("words")))
    if layout.page_section:
        name = F.when(F.col("raw").rlike(layout.page_section), F.trim(F.regexp_extract("raw", layout.page_section, 1)))
        df = df.withColumn("section", F.first(name, True).over(Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    else:
        df = df.withColumn("section", F.lit(None).cast("string"))
    df = df.filter(~skip & (F.col("text") != ""))
    begins = F.col("text").rlike("^(?:" + layout.record + ")") & (F.col("x0") <= layout.record_max_x)
    head = (F.col("text").rlike(f"^(?:{layout.heading})$") & (F.col("x0") <= layout.heading_max_x) & (F.size("values") == 0) & ~begins) if layout.heading else F.lit(False)
    df = df.withColumn("begins", begins).withColumn("head", head)
    df = df.withColumn("_run", F.sum((~F.col("head") | ~F.coalesce(F.lag("head").over(order), F.lit(False))).cast("int")).over(so_far))
    heads = df.filter("head").groupBy("doc_id", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda h: h["text"]), " ").alias("heading"), F.min("_run").alias("h_"))
    df = df.withColumn("_h", F.last(F.when(F.col("head"), F.col("_run")), True).over(so_far))
    df = df.join(heads.select("doc_id", F.col("h_").alias("_h"), "heading"), ["doc_id", "_h"], "left")
    df = df.withColumn("block", F.sum((F.col("begins") | F.col("head")).cast("int")).over(so_far))
    per = Window.partitionBy("doc_id", "block").orderBy("page", "line_no")
    df = df.withColumn("_x", F.first("x0").over(per)).withColumn("_is", F.first("begins").over(per))
    stray = ~F.col("head") & (~F.coalesce("_is", F.lit(False)) | (~F.col("begins") & (F.col("x0") <= F.col("_x") + 1)))
    df = df.withColumn("_stray", F.max(F.when(stray, True)).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    leftover = df.filter(stray | (F.coalesce("_stray", F.lit(False)) & ~F.col("head"))).select("doc_id", "page", "line_no", F.col("raw").alias("text"))
    body = df.filter(F.col("_is") & ~F.col("head") & F.col("_stray").isNull())
    starts = F.col("text").rlike(f"^(?:{layout.modifier})") & ~F.col("begins") if layout.modifier else F.lit(False)
    body = body.withColumn("m", F.sum(starts.cast("int")).over(per))
    if layout.modifier:
        toks = F.regexp_extract_all(F.regexp_extract("text", f"^((?:(?:{layout.modifier})\\s*[,;]?\\s*)+)", 1), F.lit(f"({layout.modifier})"), F.lit(1))
        body = body.withColumn("mods", F.when(starts, F.array_join(F.transform(toks, lambda t: F.regexp_replace(t, r"^(\(?[A-Z]{2})\s?[=-]\s?", "$1=")), ", ")))
        body = body.withColumn("rest", F.when(starts, F.trim(F.regexp_replace("text", f"^((?:(?:{layout.modifier})\\s*[,;]?\\s*)+)", ""))).otherwise(F.col("text")))
    else:
        body = body.withColumn("mods", F.lit(None).cast("string")).withColumn("rest", F.col("text"))
    body = body.withColumn("rest", F.when(F.col("begins"), F.trim(F.regexp_replace("text", "^(?:" + layout.record + ")", ""))).otherwise(F.col("rest")))
    g = body.groupBy("doc_id", "block", "m").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "rest"))).alias("ls"), F.max("mods").alias("modifier"),
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", F.map_entries("values").alias("v")))), lambda x: x["v"]), F.array().cast("array<struct<key:string,value:string>>"),
                    lambda a, v: F.concat(a, F.filter(v, lambda e: ~F.exists(a, lambda o: o["key"] == e["key"])))).alias("vs"),
        F.min(F.when(F.col("begins"), F.struct("page", "text", "section", "heading"))).alias("r"))
    first = g.filter("m = 0").select("doc_id", "block", "r", F.transform("ls", lambda x: x["rest"]).alias("base"))
    bare = g.groupBy("doc_id", "block").agg(F.max(F.size("vs")).alias("k")).filter("k = 0").drop("k")
    out = g.drop("r").join(first, ["doc_id", "block"])
    said = F.when(F.col("m") == 0, F.col("base")).otherwise(F.concat("base", F.transform("ls", lambda x: x["rest"])))
    out = out.select("doc_id", F.col("block").alias("record_no"), F.regexp_extract("r.text", layout.record, 1).alias("code"), F.col("r.page").alias("page"), F.col("r.section").alias("section"), F.col("r.heading").alias("heading"),
                     F.coalesce("modifier", F.lit("")).alias("modifier"), F.trim(F.array_join(F.filter(said, lambda t: t != ""), " ")).alias("description"), F.map_from_entries("vs").alias("values"))
    bare = bare.select("doc_id", F.col("block").alias("record_no"))
    empty = out.join(bare, ["doc_id", "record_no"], "left_semi").groupBy("doc_id", "record_no", "code", "page", "section", "heading").agg(F.max_by("description", F.length("description")).alias("description"))
    return out.filter(F.size("values") > 0), empty, leftover


def code_list(lines: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(doc_id, code, description, page; leftover lines): a code at the left, a description that may wrap to the right of it.

    A line as far left as the code before it that begins no record ends the description and is left over."""
    df = lines.withColumn("text", _joined(F.col("words"))).withColumn("x0", F.coalesce(F.try_element_at("words", F.lit(1))["x0"], F.lit(0.0)))
    for p in layout.skip:
        df = df.filter(~F.col("text").rlike(p))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("text").rlike("^(?:" + layout.record + ")") & (F.col("x0") <= layout.record_max_x)
    df = df.withColumn("begins", begins).withColumn("block", F.sum(F.col("begins").cast("int")).over(order))
    per = Window.partitionBy("doc_id", "block").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("x", F.first("x0").over(per)).withColumn("stray", F.max((F.col("block") == 0) | (~F.col("begins") & (F.col("x0") <= F.col("x") + 1))).over(per))
    body = df.filter("not stray").withColumn("rest", F.when(F.col("begins"), F.trim(F.regexp_replace("text", "^(?:" + layout.record + ")", ""))).otherwise(F.col("text")))
    out = body.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "text", "rest"))).alias("ls"))
    return out.select("doc_id", F.regexp_extract(F.col("ls")[0]["text"], layout.record, 1).alias("code"), F.trim(F.array_join(F.filter(F.transform("ls", lambda x: x["rest"]), lambda t: t != ""), " ")).alias("description"),
                      F.col("ls")[0]["page"].alias("page")), df.filter("stray").select("doc_id", "page", "line_no", "text")


def bulletin_value(text: Column) -> Column:
    """struct<description, units, amount, anaesthesia_units, old_units, fee_note>; null where no fee is recognised.

    ``4.5 MSU`` with or without time units (``4+6T`` style tails ``6+T``), dollars (the first of several counts, the whole
    is kept as a note), or an old and a new number at the end."""
    msu, dollars, pair = r"(?i)(\d+(?:\.\d+)?)\s*MSU\b(.*)$", r"\$\s*([\d,]+(?:\.\d+)?)(.*)$", r"(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s*$"
    get = lambda p, i: F.regexp_extract(text, p, i)
    before = lambda p: F.trim(F.regexp_replace(text, p, ""))
    after_msu, after_dollar = F.trim(get(msu, 2)), F.trim(get(dollars, 2))
    time = F.nullif(F.regexp_extract(after_msu, r"^\+?\s*(\d+)\s*\+\s*T$", 1), F.lit(""))
    none = F.lit(None).cast("string")

    def row(description, units=none, amount=none, anaesthesia=none, old=none, note=none) -> Column:
        return F.struct(description.alias("description"), units.alias("units"), amount.alias("amount"), anaesthesia.alias("anaesthesia_units"), old.alias("old_units"), note.alias("fee_note"))

    whole = lambda p: F.trim(F.regexp_extract(text, p, 0))
    return (F.when(text.rlike(msu), row(before(msu), get(msu, 1), anaesthesia=time, note=F.when(after_msu != "", whole(msu))))
            .when(text.rlike(dollars), row(before(dollars), amount=F.regexp_replace(get(dollars, 1), ",", ""), note=F.when(after_dollar != "", whole(dollars))))
            .when(text.rlike(pair), row(before(pair), get(pair, 2), old=get(pair, 1))))


def bulletin_action(announcement: Column, sentence: Column, code: Column, code_in_text: str) -> Column:
    """terminated, new or updated: a sentence that ends other codes than this one does not end it."""
    both = F.concat_ws(" ", sentence, announcement)
    named = F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(f"({code_in_text})"), F.lit(1))
    ends = both.rlike("(?i)terminat|discontinu|delet") & ((F.size(named) == 0) | F.array_contains(named, code))
    return F.when(ends, "terminated").when(F.coalesce(announcement, F.lit("")).rlike(r"\bNEW\b"), "new").otherwise("updated")


@dataclass
class Bulletin:
    """How a bulletin reads: regular expressions whose first group is the code or the date."""

    record: str
    issued: str
    announcement: str
    effective: str
    code_in_text: str
    label: str = r"^(?:Description|Billing|Note)\b"
    reach: float = 8.0   # how far a continuation may stand from the x of its row's text
    most_lines: int = 6


def bulletins(lines: DataFrame, b: Bulletin, date_of) -> tuple[DataFrame, DataFrame]:
    """(rows, leftover lines) of lines(doc_id, page, line_no, words): doc_id, page, issue_date, effective_start, action, code and the
    fields of ``bulletin_value``.

    The issue date is that of the page, else of the page before; announcement and effective date hold until the next. A
    row is a line that begins with a code, with the lines after it near its x, at most ``most_lines``, up to a label. Rows
    without a fee that are not terminated are left over. Without an effective date the issue date is taken. ``date_of``
    reads a printed date."""
    df = lines.withColumn("text", _joined(F.col("words"))).withColumn("x0", F.coalesce(F.try_element_at("words", F.lit(1))["x0"], F.lit(0.0)))
    so_far = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    got = lambda p: F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1))
    begins = F.col("text").rlike("^(?:" + b.record + ")")
    df = df.withColumn("_i", date_of(got(b.issued))).withColumn("_a", F.when(~begins, F.when(F.col("text").rlike(b.announcement), F.col("text")))).withColumn("_e", date_of(got(b.effective))).withColumn("_s", F.when(F.col("text").rlike(b.effective), F.col("text")))
    page = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("issue_date", F.coalesce(F.first("_i", True).over(page), F.last("_i", True).over(so_far)))
    df = df.withColumn("n_a", F.count("_a").over(so_far))
    df = df.withColumn("announcement", F.last("_a", True).over(so_far))
    within = Window.partitionBy("doc_id", "n_a").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("effective", F.last("_e", True).over(within)).withColumn("sentence", F.last("_s", True).over(within))
    stops = begins | F.col("_a").isNotNull() | F.col("_s").isNotNull() | F.col("_i").isNotNull() | F.col("text").rlike(b.label)
    df = df.withColumn("begins", begins).withColumn("block", F.sum(stops.cast("int")).over(so_far))
    row_x = F.when(F.col("begins"), F.coalesce(F.try_element_at("words", F.lit(2))["x0"], F.col("x0")))
    per = Window.partitionBy("doc_id", "block").orderBy("page", "line_no")
    df = df.withColumn("row_x", F.first(row_x).over(per)).withColumn("is_row", F.first("begins").over(per)).withColumn("k", F.row_number().over(per))
    part = F.col("is_row") & (F.col("begins") | ((F.abs(F.col("x0") - F.col("row_x")) <= b.reach) & (F.col("k") <= b.most_lines + 1)))
    body = df.filter(part)
    rows = body.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))).alias("ls"), *[F.max(F.when(F.col("begins"), F.col(c))).alias(c) for c in ("issue_date", "effective", "announcement", "sentence")])
    code = F.regexp_extract(F.col("ls")[0]["text"], b.record, 1)
    text = F.trim(F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["text"]), " "), "^(?:" + b.record + ")", ""))
    rows = rows.withColumn("code", code).withColumn("said", F.trim(F.regexp_replace(text, r"\s*\.{2,}\s*", " "))).withColumn("v", bulletin_value(F.col("said")))
    rows = rows.withColumn("action", bulletin_action(F.col("announcement"), F.col("sentence"), F.col("code"), b.code_in_text))
    keep = F.col("v").isNotNull() | (F.col("action") == "terminated")
    out = rows.filter(keep).select("doc_id", F.col("ls")[0]["page"].alias("page"), "issue_date", F.coalesce("effective", "issue_date").alias("effective_start"), "action", "code", F.coalesce("v.description", "said").alias("description"), "v.units", "v.amount", "v.anaesthesia_units", "v.old_units", "v.fee_note")
    lost = rows.filter(~keep).select("doc_id", F.explode("ls").alias("l")).select("doc_id", "l.page", "l.line_no", "l.text")
    other = df.filter(F.col("is_row") & ~part).select("doc_id", "page", "line_no", "text")
    return out, lost.unionByName(other)


def profile(text: str) -> tuple[str, Layout | Bulletin]:
    """(payer, layout) from a TOML profile: payer, kind (fees, codes, bulletins), record, and the fields of the layout.

    Columns are given as name = [from, to]; unknown kinds and fields, and patterns that do not compile, are errors."""
    import re
    import tomllib

    data = tomllib.loads(text)
    payer, kind = data.pop("payer"), data.pop("kind", "fees")
    if kind not in ("fees", "codes", "bulletins"):
        raise ValueError(f"unknown kind {kind!r}")
    made = Bulletin if kind == "bulletins" else Layout
    unknown = set(data) - set(made.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown fields {', '.join(sorted(unknown))}")
    if "columns" in data:
        bad = [c for c, v in data["columns"].items() if len(v) != 2 or v[0] > v[1]]
        if bad:
            raise ValueError(f"columns need a from and a to: {', '.join(bad)}")
        data["columns"] = {c: (float(a), float(z)) for c, (a, z) in data["columns"].items()}
    data = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    for k in ("record", "heading", "page_section", "modifier", "leader", "value", "issued", "announcement", "effective", "label", "code_in_text"):
        if data.get(k):
            re.compile(data[k])
    return payer, made(**data)
