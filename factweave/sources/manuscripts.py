"""Web pages and manuscripts as text and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """Headings as ##, breaks as lines, tags away, six entities read, at most one empty line."""
    s = F.coalesce(html, F.lit(""))
    for pattern, new in (
        (r"(?i)<h[123][^>]*>([\s\S]*?)</h[123]>", "\n\n## $1\n\n"),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</p>", "\n\n"),
        (r"(?i)</li>", "\n"),
        (r"<[^>]+>", ""),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        (r"\n{3,}", "\n\n"),
    ):
        s = F.regexp_replace(s, pattern, new)
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def scenes(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """A manuscript's scenes by the first rule that applies: --- lines, ## headings, Chapter headings, gaps of three lines, else whole."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"^\s+|\s+$", "")
    d = docs.select(F.col(id_col).alias("id"), t.alias("t"))
    trimmed = lambda parts: F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    full = lambda parts: F.filter(trimmed(parts), lambda p: p != "")
    gaps = F.filter(trimmed(F.split("t", r"\n\n\n+")), lambda p: F.length(p) >= 80)
    parts = (
        F.when(F.col("t").rlike(r"\n---\n"), full(F.split("t", r"\n---\n")))
        .when(F.col("t").rlike(r"(?m)^##\s+"), full(F.split("t", r"(?m)(?=^##\s+)")))
        .when(F.col("t").rlike(r"(?im)^Chapter\s+\d+"), full(F.split("t", r"(?im)(?=^Chapter\s+\d+)")))
        .when(F.col("t").rlike(r"\n\n\n+") & (F.size(gaps) > 1), gaps)
        .otherwise(F.array("t"))
    )
    parts = F.when(F.size(parts) == 0, F.array("t")).otherwise(parts)
    return d.select("id", F.posexplode(parts).alias("p", "text")).select("id", (F.col("p") + 1).cast("long").alias("scene_number"), "text")
