"""Text functions of the terminology operators, as native column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and patterns that the matching rules depend on.
UNSPECIFIED_WORDS = ["nos", "unspecified", "unspec"]
FILLER_WORDS = [*UNSPECIFIED_WORDS, "nec", "site", "of", "the", "a", "an", "and", "or", "in", "to", "by", "for", "on", "disorder", "finding", "condition", "specified"]
SPELLINGS = [("^disk", "disc"), ("haem", "hem"), ("^oesoph", "esoph"), ("^oedem", "edem"), ("aemia", "emia"), ("tumour", "tumor"),
             ("^paed", "ped"), ("^orthopaed", "orthoped"), ("^foet", "fet"), ("^diarrhoea", "diarrhea"), ("colour", "color"), ("^gynaec", "gynec"), ("^leukaem", "leukem")]
CONTEXT_WORDS = ("aftercare subsequent late pregnancy pregnant delivery puerperium puerperal childbirth newborn perinatal neonatal fetu fetal maternal postpartum "
                 "postprocedural intraoperative postoperative complicating complication congenital following abortion personal history family screening sequela "
                 "encounter war terrorism").split()
DISEASE_WORD = r"(itis|osis|emia|oma|pathy|algia|plegia|trophy|ectasia|iasis|ism|rrhea|rrhage|cele)$|^(diabete|cancer|asthma|gout|hernia|ulcer|eczema|psoriasi)$"
MANIFESTATION = r"(?i)\bin (diseases|conditions) classified elsewhere\b"
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["the", "a", "an"]
MONTHS = "january february march april may june july august september october november december".split()


@functools.cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """What NFKD without combining marks makes of single characters: (from, to, characters that become several)."""
    drop, one_from, one_to, many = [], [], [], {}
    for cp in range(128, sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if unicodedata.combining(c):
            drop.append(c)
            continue
        if 0xAC00 <= cp <= 0xD7A3 or not unicodedata.decomposition(c):
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1:
            if d.isascii() or d.lower().isascii():
                one_from.append(c)
                one_to.append(d)
        elif any(x.isascii() and x.isalnum() for x in d):
            many[c] = d
        elif d == "":
            drop.append(c)
    return "".join(one_from + drop), "".join(one_to), many


def _class(chars) -> str:
    """A regular-expression class of characters, as ranges."""
    cps = sorted(map(ord, chars))
    runs: list[list[int]] = []
    for cp in cps:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in runs) + "]"


def listed(words: list[str]) -> Column:
    """A constant array of strings."""
    return F.split(F.lit("\x01".join(words)), "\x01")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normalize(text: Column) -> Column:
    """Lookup key: accents stripped, lower case, apostrophes dropped, other punctuation to single blanks, trimmed.

    Plain ASCII takes a short way; the character tables are only met by text that needs them."""
    src, dst, many = _foldings()
    wide = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in many.items())), F.lit("\x01"), F.lit("\x02"))
    wide_class = _class(many)

    def fold(t: Column) -> Column:
        spread = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(wide, c), c)), "")
        return F.when(t.rlike(r"^\p{ASCII}*$"), t).when(t.rlike(wide_class), F.translate(spread, src, dst)).otherwise(F.translate(t, src, dst))

    folded = let(text, fold)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), "['’]", ""), "[^a-z0-9]+", " "))


def token_fold(word: Column) -> Column:
    """One spelling and number of a word."""
    for pattern, to in SPELLINGS:
        word = F.regexp_replace(word, pattern, to)
    return F.regexp_replace(word, "^(.{3,}[^sui])s$", "$1")


def word_set(term: Column) -> Column:
    """struct<key: sorted distinct folded words (null if too vague), unspecified: a word for that was dropped>."""
    t = F.regexp_replace(F.regexp_replace(term, r"\([^)]*\)|\[[^\]]*\]", " "), r"(?i)\b(without|except|excluding|other than)\b[^,;]*", " ")
    folded = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(normalize(t), " "), lambda w: w != ""), token_fold)))
    fillers, vague_words = listed(FILLER_WORDS), listed(UNSPECIFIED_WORDS)

    def pick(all_words: Column) -> Column:
        key = let(F.array_except(all_words, fillers), lambda k: F.when(~((F.size(k) == 0) | ((F.size(k) == 1) & (F.length(k[0]) < 4))), k))
        return F.struct(key.alias("key"), F.arrays_overlap(all_words, vague_words).alias("unspecified"))

    return let(folded, pick)


def dotted(code: Column, vocabulary: Column) -> Column:
    """A code as printed: a dot after three characters, after four for ICD-9 codes that begin with E."""
    bare = F.regexp_replace(code, r"\.", "")
    at = F.when((vocabulary == "ICD9CM") & bare.startswith("E"), F.lit(4)).otherwise(F.lit(3))
    return F.when(F.length(bare) <= at, bare).otherwise(F.concat(bare.substr(F.lit(1), at), F.lit("."), bare.substr(at + 1, F.length(bare))))


def dotted_procedure(code: Column) -> Column:
    bare = F.regexp_replace(code, r"\.", "")
    return F.when(F.length(bare) <= 2, bare).otherwise(F.concat(F.substring(bare, 1, 2), F.lit("."), bare.substr(F.lit(3), F.length(bare))))


def code_domain(code: Column) -> Column:
    """symptom for chapter R, observation for V to Z, else condition."""
    first = F.upper(F.substring(code, 1, 1))
    return F.when(first == "R", "symptom").when(first.between("V", "Z"), "observation").otherwise("condition")


def icd9_domain(code: Column, procedure: Column | bool = False) -> Column:
    """procedure for codes of the procedure list, observation for V and E codes, else condition."""
    first = F.upper(F.substring(code, 1, 1))
    return F.when(F.lit(procedure) if isinstance(procedure, bool) else procedure, "procedure").when(first.isin("V", "E"), "observation").otherwise("condition")


def code_class(code: Column, billable: Column) -> Column:
    return F.when(F.length(F.regexp_replace(code, r"\.", "")) == 3, "category").when(billable, "code").otherwise("subcategory")


def compatible(a: Column, b: Column) -> Column:
    """Whether a concept of domain ``a`` may have a code of domain ``b``: procedures go with procedures, other kinds with
    other kinds; a concept of domain ``other`` with any."""
    return (a == "other") | ((a == "procedure") == (b == "procedure"))


def singular(term: Column) -> Column:
    """The last word without a plural ending."""
    ies = term.rlike(r"(^|\s)\S{2,}ies$")
    return F.when(ies, F.regexp_replace(term, "ies$", "y")).otherwise(F.regexp_replace(term, r"((?:^|\s)\S{2,}[^sui\s])s$", "$1"))


def first_variant(title: Column) -> Column:
    """``Attack, attacks`` -> ``Attack``: the first spelling if all others share its first four letters."""
    parts = F.transform(F.split(title, ","), lambda p: F.trim(p))
    stem = F.lower(F.substring(parts[0], 1, 4))
    return F.when((F.size(parts) > 1) & F.forall(F.slice(parts, 2, 1000), lambda p: F.lower(p).startswith(stem)), parts[0]).otherwise(title)


def printed_fee(value: Column, column: Column) -> Column:
    """struct<number, note, kind> of a printed fee: ``62+MU``, ``$45.00`` in a units column, text only."""
    t = F.trim(value)
    num = F.regexp_extract(t, r"^\$?\s*([\d,]+(?:\.\d+)?)", 1)
    ok = (num != "") & ~t.contains("%")
    note = F.nullif(F.trim(F.when(ok, F.regexp_replace(t, r"^\$?\s*[\d,]+(?:\.\d+)?\s*", "")).otherwise(t)), F.lit(""))
    kind = F.when(ok & t.startswith("$"), F.lit("amount")).when(ok, column)
    return F.struct(F.when(ok, F.regexp_replace(num, ",", "").try_cast("decimal(12,4)")).alias("number"), note.alias("note"), kind.alias("kind"))


def printed_date(text: Column) -> Column:
    """A date such as ``March 3rd, 2021`` or ``3 Mar 2021`` or ISO; null if it is none."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[,.]", " ")))
    month = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(i + 1))])
    a, b = r"^([a-z]{3,9})\s+(\d{1,2})\s+(\d{4})$", r"^(\d{1,2})\s+([a-z]{3,9})\s+(\d{4})$"
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("1"))
    word = F.when(t.rlike(a), F.regexp_extract(t, a, 1)).when(t.rlike(b), F.regexp_extract(t, b, 2))
    day = F.when(t.rlike(a), F.regexp_extract(t, a, 2)).when(t.rlike(b), F.regexp_extract(t, b, 1))
    year = F.regexp_extract(t, r"(\d{4})$", 1)
    good = F.exists(listed(MONTHS), lambda m: (m == word) | ((F.length(word) == 3) & m.startswith(word)) | ((word == "sept") & (m == "september")))
    made = F.when(good, F.concat_ws("-", year, F.lpad(F.try_element_at(month, F.substring(word, 1, 3)).cast("string"), 2, "0"), F.lpad(day, 2, "0")))
    return F.try_to_date(F.when(iso.isNotNull(), t).otherwise(made), "yyyy-MM-dd")
