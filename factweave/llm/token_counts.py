"""Token counts by section (1), from offsets.

A whole document is encoded once. Tokens have character spans; sections have character spans; a
token counts for the section that its span meets. The rule for a token over a boundary: it goes
to the section that has most of its characters, of equal ones to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, two
from .tokens import encoder, public_path
from .words import pieces

SCHEMA = "doc_id long, section long, start long, stop long, n_tokens long, n_crossing long"


def sections(text: str) -> list[int]:
    """Where sections start: at the text's start and behind each line break. An empty text has one, empty section."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def allocate(token_edges: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and, of those, the ones that reach over a boundary.

    Tokens follow one another (edge i to i + 1, in characters); the interval join is a search in
    the sorted starts. A token of no whole character counts for the section where it stands.
    """
    a, b = token_edges[:-1], token_edges[1:]
    low = np.searchsorted(starts, np.minimum(a, max(size - 1, 0)), "right") - 1
    high = np.maximum(low, np.searchsorted(starts, b - 1, "right") - 1)
    chosen = low.copy()
    cross = np.flatnonzero(high > low)
    ends = np.append(starts[1:], size)
    for i in cross.tolist():
        span = np.arange(low[i], high[i] + 1)
        chosen[i] = span[np.argmax(np.minimum(ends[span], b[i]) - np.maximum(starts[span], a[i]))]
    n = len(starts)
    return np.bincount(chosen, minlength=n), np.bincount(chosen[cross], minlength=n)


def section_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and section (line): characters start to stop, its tokens, and how many of them cross a boundary.

    The sections' counts add up to the document's tokens. Where a character is of several tokens,
    each token has the characters that end in it. A null or empty text has one section without
    tokens. Rows stay apart whatever their ids; an empty table gives none. The vocabulary must
    keep every byte.
    """
    path = tokenizer or public_path("byte_bpe_50k.json")

    def build(batches: Iterator[pa.RecordBatch]):
        encode = encoder(path)
        for batch in batches:
            for part, data, offsets in pieces(batch):
                ids, counts = encode.encode(data, offsets)
                text_ends = np.concatenate(([0], np.cumsum((np.append(data[1:], 0) & 0xC0) != 0x80)))  # characters that end before a byte
                at, rows = 0, [[], [], [], [], [], []]
                breaks = np.flatnonzero(data == 0x0A) + 1
                for i, (doc, n) in enumerate(zip(part.column(0).to_pylist(), counts.tolist(), strict=True)):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    edges = text_ends[a + np.concatenate(([0], np.cumsum(encode.width[ids[at : at + n]])))] - text_ends[a]
                    at += n
                    inner = breaks[np.searchsorted(breaks, a, "right") : np.searchsorted(breaks, b, "left")]
                    starts = np.concatenate(([0], text_ends[inner] - text_ends[a]))
                    size = int(text_ends[b] - text_ends[a])
                    total, crossing = allocate(edges, starts, size)
                    rows[0].append(np.full(len(starts), i))
                    for column, x in zip(rows[1:], (np.arange(len(starts)), starts, np.append(starts[1:], size), total, crossing), strict=True):
                        column.append(x)
                who, *rest = (np.concatenate(c) for c in rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), *(pa.array(x, pa.int64()) for x in rest)], SCHEMA.replace(",", "").split(" ")[::2])

    return two(docs, id_col, text_col).mapInArrow(build, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(read(spark, sf_dir, "documents"))
