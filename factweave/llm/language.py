"""Language identification by hyperdimensional profiles (10).

Each letter has a fixed random vector of +1 and -1. A trigram of lower-case letters (with a
blank at a word's edges) is bound from its letters' vectors, permuted by their place; a text's
profile is the bundle (sum) of its trigrams' vectors, a language's prototype the bundle over its
training texts. A text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, two
from .words import pieces

DIMENSIONS = 1024
#: Rows of letter vectors; a letter takes the row of its code point modulo this.
LETTERS = 4096
UNKNOWN = "und"
_BITS = 12


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> row + 1 of its lower-case letter, 0 for other characters."""
    rows = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            rows[c] = 1 + ord(low[0]) % (LETTERS - 1)
    return rows


@functools.cache
def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors (row 0: the blank) as they stand at each place of a trigram; the permutation is a rotation."""
    flat = np.random.Generator(np.random.PCG64(10)).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return np.roll(flat, 2, 1), np.roll(flat, 1, 1), flat


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of each text: text number, trigram, count; and whether each text has a letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # in code points
    rows = _letters()[points]
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(before))
    gap = np.zeros(len(rows) + n + 1, np.int64)  # a blank before each text and at the end
    gap[np.arange(len(rows)) + text + 1] = rows
    of = np.zeros(len(gap), np.int64)
    of[np.arange(len(rows)) + text + 1] = text
    middle = np.flatnonzero(gap[1:-1]) + 1
    code = gap[middle - 1] << 2 * _BITS | gap[middle] << _BITS | gap[middle + 1]
    keys, counts = np.unique(of[middle] << 3 * _BITS | code, return_counts=True)
    has = np.zeros(n, bool)
    has[keys >> 3 * _BITS] = True
    return keys >> 3 * _BITS, keys & (1 << 3 * _BITS) - 1, counts, has


def _bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first, second, third = _vectors()
    mask = LETTERS - 1
    out = np.zeros(DIMENSIONS)
    for i in range(0, len(codes), 4096):
        c = codes[i : i + 4096]
        bound = first[c >> 2 * _BITS] * second[c >> _BITS & mask] * third[c & mask]
        out += counts[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
    return out


def prototypes(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a unit vector for each, from all rows of (lang, text) where neither is null.

    Each task sends one vector for each language, whatever its rows; the driver gets
    languages x DIMENSIONS numbers.
    """
    small_batches(texts.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, offsets in pieces(batch):
                langs = np.array(part.column("lang").to_pylist(), object)
                text, codes, counts, _ = _trigrams(data, offsets)
                for lang in set(langs):
                    mine = (langs == lang)[text]
                    code, back = np.unique(codes[mine], return_inverse=True)
                    sums[lang] = sums.get(lang, 0) + _bundle(code, np.bincount(back, counts[mine]))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInArrow(build, "lang string, bundle array<double>")
    rows = parts.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        out[langs.index(r.lang), r.place] = r.x
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.where(norm > 0, norm, 1)


def identify(docs: DataFrame, langs: list[str], profiles: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score (the largest cosine, at least 0) for each row.

    A null text, one without a letter, or no learned language gives `und` and 0. Ties go to
    the language first in order. Rows stay apart whatever their ids; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, profiles.astype(np.float64)))  # languages x DIMENSIONS

    def build(batches: Iterator[pa.RecordBatch]):
        names, vectors = shared.value
        for batch in batches:
            for part, data, offsets in pieces(batch):
                text, codes, counts, has = _trigrams(data, offsets)
                at = np.searchsorted(text, np.arange(len(has) + 1))
                pred, score = [UNKNOWN] * len(has), np.zeros(len(has))
                for i in np.flatnonzero(has) if names else ():
                    v = _bundle(codes[at[i] : at[i + 1]], counts[at[i] : at[i + 1]])
                    cosines = vectors @ v / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(cosines.argmax())
                    pred[i], score[i] = names[best], min(1.0, max(0.0, float(cosines[best])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return two(docs, id_col, text_col).mapInArrow(build, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    langs, profiles = prototypes(docs.where(~held).select("lang", "text"))
    out = identify(docs, langs, profiles)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
