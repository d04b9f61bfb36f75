"""Units and numbers written as text: parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of each unit in a value, once lower-cased and freed of blanks, dots and brackets.
VALUE_UNITS = {
    "units": {
        "msu": "msus?",
        "milli_msu": "m-?msus?|milli-?msus?",
        "point": "pts?|points?",
        "rvu": "rvus?",
    },
    "amount": {
        "hundred_dollars": r"x\$100|hundreddollars?|hundredsofdollars",
        "thousand_dollars": r"k\$|\$k|k|thousanddollars?|thousandsofdollars|x\$1000",
        "cent": "c|¢|cts?|cents?",
        "dollar": r"\$|c\$|\$c|cad|cad\$|\$cad|dollars?",
    },
    "duration": {
        "minute": "m|mins?|minutes?",
        "hour": "h|hrs?|hours?",
        "time_unit": "tu|tus|timeunits?",
    },
}
#: Phrases of a description that state the unit of a quantity.
TEXT_UNITS = {
    "units": {
        "milli_msu": r"[(\[][^)\]]*\b(milli-?msu|mmsu)\b[^)\]]*[)\]]",
        "point": r"points?, not msu|[(\[][^)\]]*\b(pts|points?)\b[^)\]]*[)\]]|\b(listed|quoted) in points",
        "rvu": r"[(\[][^)\]]*\b(rvus?|relative value units?)\b[^)\]]*[)\]]|\b(listed|quoted) in rvu",
        "msu": r"[(\[][^)\]]*\bmsu\b[^)\]]*[)\]]|\b(listed|quoted) in msu",
    },
    "amount": {
        "hundred_dollars": r"[(\[][^)\]]*\bhundreds of dollars[^)\]]*[)\]]|- \$100s",
        "thousand_dollars": r"[(\[][^)\]]*\bthousands of dollars[^)\]]*[)\]]|- \$1000s",
        "cent": r"[(\[][^)\]]*\b(cents|centimes)\b[^)\]]*[)\]]|\[¢\]|\b(quoted|listed) in cents",
        "dollar": r"[(\[][^)\]]*\bdollars\b[^)\]]*[)\]]|\[\$\]|\b(quoted|listed) in dollars",
    },
    "duration": {
        "hour": r"[(\[][^)\]]*\b(in hours|units?: hours?|durée en heures)[^)\]]*[)\]]",
        "minute": r"[(\[][^)\]]*\b(in minutes|units?: minutes?|durée en minutes)[^)\]]*[)\]]",
        "time_unit": r"[(\[][^)\]]*\btime units?[^)\]]*[)\]]",
    },
}
CLOCK = r"^\s*(\d+)\s*h(?:rs?|ours?)?\.?\s*(\d{1,2})\s*(?:m|min|mins|minutes)?\.?\s*$"
NUMBER = r"(\d[\d,]*(?:\.\d+)?|\.\d+)"


def bare(value: Column) -> Column:
    """The value without the printed tails +MU and +T."""
    return F.trim(F.regexp_replace(value, r"(?i)\s*\+\s*(mu|t)\s*$", ""))


def number(value: Column) -> Column:
    """First number in the text as decimal(24,8): a comma before just two final digits is a decimal sign, others group
    thousands. Null for percentages and for text without a digit."""
    raw = F.regexp_extract(bare(value), NUMBER, 1)
    dec = raw.rlike(r"^[\d,]*\d,\d{2}$")
    plain = F.when(dec, F.concat(F.regexp_replace(F.regexp_replace(raw, r",\d{2}$", ""), ",", ""), F.lit("."), F.substring(raw, -2, 2)))
    plain = plain.otherwise(F.regexp_replace(raw, ",", ""))
    ok = value.isNotNull() & (raw != "") & ~value.contains("%")
    return F.when(ok & ~value.rlike(CLOCK), plain.try_cast("decimal(24,8)")).when(ok, clock_minutes(value))


def clock_minutes(value: Column) -> Column:
    hours = F.regexp_extract(value, CLOCK, 1).try_cast("decimal(24,8)")
    return (hours * 60 + F.regexp_extract(value, CLOCK, 2).try_cast("decimal(24,8)")).cast("decimal(24,8)")


def is_clock(value: Column) -> Column:
    """Hours with minutes, such as 1h15."""
    return F.coalesce(value.rlike(CLOCK), F.lit(False))


def _matched(text: Column, table: dict[str, str], whole: bool) -> Column:
    out = None
    for unit, pattern in table.items():
        hit = text.rlike(f"^(?:{pattern})$" if whole else pattern)
        out = F.when(hit, F.lit(unit)) if out is None else out.when(hit, F.lit(unit))
    return out


def unit_in_value(value: Column, quantity: str) -> Column:
    """The unit the value states, or null."""
    rest = F.lower(F.regexp_replace(bare(value), NUMBER, "")) if quantity != "amount" else F.lower(F.regexp_replace(bare(value), r"^(\D*?)" + NUMBER, "$1"))
    return _matched(F.regexp_replace(rest, r"[\s.()]", ""), _squeezed(quantity), True)


def _squeezed(quantity: str) -> dict[str, str]:
    return {u: p + ("|hours" if u == "hour" else "") for u, p in VALUE_UNITS[quantity].items()}


def unit_in_text(text: Column, quantity: str) -> Column:
    """The unit a description states for the quantity, or null."""
    return _matched(F.lower(text), TEXT_UNITS[quantity], False)
