"""Word files as text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNREADABLE = "Could not read text from this Word file. Try Save As .txt or export from Word."


def _paragraph(p: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    text = "".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter())
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = "" if style is None else (style.get(f"{_W}val") or "").replace(" ", "").lower()
    if name in ("heading1", "heading2", "heading3"):
        return f"\n\n## {text}\n\n" if text else ""
    listed = p.find(f"{_W}pPr/{_W}numPr") is not None
    return f"{text}\n" if listed else f"{text}\n\n"


def text_of(content: bytes | None) -> str | None:
    """Headings of the first three levels as ##, list items as lines, paragraphs apart; null where the file can't be read or has no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z, z.open("word/document.xml") as f:
            root = ElementTree.parse(f).getroot()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    text = "".join(_paragraph(p) for p in root.iter(f"{_W}p"))
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip() or None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of the .docx files in a folder; error tells which have no readable text."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [text_of(x) for x in f["content"]]
            yield pd.DataFrame({"path": f["path"], "text": texts, "error": [None if t else UNREADABLE for t in texts]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("content")).mapInPandas(batches, "path string, text string, error string")
