"""Files by kind out of folders and archives, and their text."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def find(spark: SparkSession, paths: list[str], kinds: dict[str, str]) -> DataFrame:
    """kind, path, name, content: the first file of each kind by path, archives inside archives opened.

    ``kinds`` maps a kind to a regular expression on the base name. Archives are opened by the tasks that read them;
    the first of a kind is the least path, members in the order of their archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    patterns = {k: re.compile(p, re.I) for k, p in kinds.items()}

    def inside(path: str, data: bytes, order: str):
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i, m in enumerate(z.namelist()):
                    if not m.endswith("/"):
                        yield from inside(f"{path}!{m}", z.read(m), f"{order}!{i:06d}")
            return
        name = re.split(r"[/!]", path)[-1]
        for kind, p in patterns.items():
            if p.search(name):
                yield kind, path, name, bytes(data), order

    def run(batches):
        for pdf in batches:
            rows = [r for path, data in zip(pdf["path"], pdf["content"]) for r in inside(path, data, path)]
            yield pd.DataFrame(rows, columns=["kind", "path", "name", "content", "place"])

    found = files.mapInPandas(run, "kind string, path string, name string, content binary, place string")
    first = found.groupBy("kind").agg(F.min("place").alias("place"))
    return found.join(first, ["kind", "place"]).select("kind", "path", "name", "content")


def decoded(content: Column) -> Column:
    """UTF-8 text, or windows-1252 where the bytes are no UTF-8; without a byte-order mark."""
    # windows-1252 is Latin-1 but for the bytes 80 to 9f
    other = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    other = {k: v for k, v in other.items() if v}
    latin = F.translate(F.decode(content, "iso-8859-1"), "".join(other), "".join(other.values()))
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), latin)
    return F.regexp_replace(text, "^﻿", "")


def lines(found: DataFrame) -> DataFrame:
    """kind, line_no (from 1), line of the text of ``find``'s files."""
    text = found.select("kind", decoded(F.col("content")).alias("text"))
    return text.select("kind", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line")).select("kind", (F.col("n") + 1).alias("line_no"), "line")


def strict_csv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """A CSV file with a header: names trimmed and lower case, values trimmed, missing ones empty. Quotes are doubled."""
    df = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    df = df.toDF(*[c.strip().lstrip("﻿").lower() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    return df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])


def commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose lines that begin with # are comments."""
    df = spark.read.option("header", "true").option("escape", '"').option("comment", "#").csv(path)
    return df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lower()) for c in df.columns])


def page_numbers(spec: str | None, last: int) -> list[int]:
    """``3-5,9,12-`` as page numbers up to ``last``; null means all."""
    if not spec:
        return list(range(1, last + 1))
    out: list[int] = []
    for part in spec.split(","):
        a, dash, b = part.strip().partition("-")
        out += range(int(a or 1), (int(b) if b else last) + 1) if dash else [int(a)]
    return out
