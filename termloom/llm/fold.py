"""Folding of texts to words, in Python stages."""

from __future__ import annotations

import re
import unicodedata

_APOSTROPHES = {ord("'"): None, ord("’"): None}
_OTHER = re.compile(r"[^a-z0-9]+")


def fold(text: str) -> str:
    """Without case, accents, width, punctuation, apostrophes and spacing: words of a-z and 0-9 between single blanks."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _OTHER.sub(" ", text.lower().translate(_APOSTROPHES)).strip()


def words(text: str | None) -> list[str]:
    return fold(text).split() if text else []


def words_with_places(text: str) -> list[tuple[str, int, int]]:
    """The words of ``fold`` with the range of characters each comes from."""
    out: list[tuple[str, int, int]] = []
    buf, start, end = [], 0, 0
    for i, c in enumerate(text):
        parts = c if c.isascii() else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c in "'’" or (parts == "" and not c.isascii()):
            continue
        for x in parts.lower():
            if x in "'’":
                continue
            if ("a" <= x <= "z") or ("0" <= x <= "9"):
                if not buf:
                    start = i
                buf.append(x)
                end = i + 1
            elif buf:
                out.append(("".join(buf), start, end))
                buf = []
    if buf:
        out.append(("".join(buf), start, end))
    return out
