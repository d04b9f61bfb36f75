"""What an extraction writes: a CSV file with a fixed head and a short report in Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 200


def write_csv(rows: DataFrame, path: str, first: list[str]) -> None:
    """One CSV file with a header: the columns ``first`` that there are, then the others by name. Quotes are doubled."""
    have = [c for c in first if c in rows.columns]
    cols = have + sorted(c for c in rows.columns if c not in have)
    rows.select(*[F.col(c).cast("string").alias(c) for c in cols]).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def report(rows: DataFrame, leftover: DataFrame, known: DataFrame | None = None, by: str = "page", sample: int = SAMPLE) -> str:
    """Counts, rows per ``by``, at most ``sample`` lines that were left over, and codes that ``known`` lacks."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("c")).first()
    out = ["# Extraction", "", f"Rows: {n['n']}", f"Codes: {n['c']}", f"Lines left over: {leftover.count()}", "", f"## Rows per {by}", ""]
    out += [f"- {r[by]}: {r['n']}" for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).limit(10_000).collect()]
    if known is not None:
        missing = rows.select("code").distinct().join(known.select("code"), "code", "left_anti")
        out += ["", "## Codes missing from the comparison", "", f"{missing.count()} in all"] + [f"- {r['code']}" for r in missing.orderBy("code").limit(sample).collect()]
    out += ["", "## Left over", ""] + [f"- p. {r['page']}: {r['text']}" for r in leftover.orderBy("page", "line_no").limit(sample).collect()]
    return "\n".join(out) + "\n"
