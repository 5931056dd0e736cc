"""Quality classifier (2): logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A token is a run of letters, digits and non-ASCII characters, or a run of other visible ASCII.
Two families of n-grams are hashed into one space: of lower-case tokens (n = 1, 2) and of token
shapes (n = 1, 2, 3; case, kind, and whether the token repeats the one before). Each family of a
text has unit length, so long and short texts weigh alike. A score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, small_batches, two, unused
from .words import Words, mix, pieces, windows

BITS = 20
#: Texts learnt from: those labelled rows whose hashed id is smallest. This is the stated bound of the sample.
TRAIN_ROWS = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.2
KEEP_AT = 0.7
#: Bytes of vectors that the driver takes at once; more come as a stream, part by part.
DRIVER_BYTES = 64 << 20
#: The text's bias has its own slot.
BIAS = 1 << BITS


def _token_classes() -> np.ndarray:
    table = np.full(256, 2, np.int8)
    table[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = 1
    table[list(range(0x00, 0x21)) + [0x7F]] = 0
    return table


_CLASSES = _token_classes()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, slot and value of each feature of some texts, by text. Every text has the bias."""
    n = len(offsets) - 1
    words = Words(data, offsets, _CLASSES, lower=True)
    hashes, of = words.hashes(), np.repeat(np.arange(n), words.counts())
    keys, weights, texts = [np.arange(n, dtype=np.int64) << BITS + 1 | BIAS], [np.ones(n)], [np.arange(n)]
    if len(words):
        head = data[words.starts]
        second = data[np.minimum(words.starts + 1, words.ends - 1)]
        upper = lambda x: (x >= 65) & (x <= 90) | (x == 0xC3)  # noqa: E731  a two-byte letter counts as either case
        shape = np.where(words.kinds == 2, 4, np.where((head >= 48) & (head <= 57), 3, upper(head) * 1 + (upper(head) & upper(second) & (words.ends - words.starts > 1)) * 1))
        repeat = np.zeros(len(words), np.int64)
        repeat[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        shapes = mix((shape + 8 * repeat + 1).astype(np.uint64))
        for family, base, longest in ((1, hashes, 2), (2, shapes, 3)):
            slots, owner = [], []
            for k in range(1, longest + 1):
                h = windows(base, k)
                inside = of[: len(h)] == of[k - 1 : k - 1 + len(h)]
                slots.append((mix(h[inside] + np.uint64(family)) >> np.uint64(64 - BITS)).astype(np.int64))
                owner.append(of[: len(h)][inside])
            key, count = np.unique(np.concatenate(owner) << BITS + 1 | np.concatenate(slots), return_counts=True)
            text, value = key >> BITS + 1, np.log1p(count)
            keys.append(key)
            texts.append(text)
            weights.append(value / np.sqrt(np.bincount(text, value * value, n))[text])
    return np.concatenate(texts), np.concatenate(keys) & (1 << BITS + 1) - 1, np.concatenate(weights)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> list[tuple[int, int]]:
    """(doc_id, label) of the `rows` labelled rows of smallest hashed id; crc32(id) mod 4 = 2 is held out. Null ids or labels are no labels."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return [(r.doc_id, r.y) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the hashed slots, learnt from at most `rows` labelled texts, whole.

    Features are made on the executors and written to the shared folder; the driver reads the
    sparse vectors in the order of a hash, part by part if they are many bytes. Of rows with one
    id only one counts. Without labelled texts all weights are 0, so every score is 0.5.
    """
    chosen = sample(docs, labels, label, rows)
    spark = docs.sparkSession
    picked = two(docs, id_col, text_col).join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int")), "doc_id").select("doc_id", "y", "text")

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in pieces(batch):
                text, slot, value = features(data, offsets)
                order = np.argsort(text, kind="stable")
                at = np.searchsorted(text[order], np.arange(part.num_rows + 1))
                slot, value = slot[order].astype(np.int32), value[order].astype(np.float32)
                pack = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())  # noqa: B023, E731
                place = pa.array([hash((i, 17)) for i in part.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([place, part.column(0), part.column(1), pack(slot), pack(value)], ["place", "doc_id", "y", "slot", "value"])

    made = picked.mapInArrow(build, "place long, doc_id long, y int, slot binary, value binary")
    one = made.groupBy("place", "doc_id").agg(F.min(F.struct("slot", "value", "y")).alias("x")).select("place", "doc_id", "x.*")
    found = saved(one.sort("place", "doc_id"), "quality-vectors")
    size = found.agg(F.sum(F.octet_length("slot") + F.octet_length("value"))).first()[0] or 0
    read_back = found.sort("place", "doc_id")
    held = read_back.collect() if size <= DRIVER_BYTES else None
    return ftrl(lambda: ((np.frombuffer(r.slot, np.int32), np.frombuffer(r.value, np.float32), r.y) for r in (read_back.toLocalIterator() if held is None else held)))


def ftrl(examples: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal: per-slot rates, L1 and L2, one example at a time in the given order, which each call of examples starts anew."""
    z, n = np.zeros(2 * BIAS), np.zeros(2 * BIAS)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for slot, value, y in examples():
            zs, ns = z[slot], n[slot]
            w = weights(zs, ns)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[slot] = zs + g - sigma * w
            n[slot] = ns + g * g
    return weights(z, n)[: BIAS + 1]


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """score for each row: the chance that its label is 1, from its whole text alone.

    An empty or null text has only the bias. Rows stay apart whatever their ids; an empty table
    gives none. With keep, the input's columns come along (but for one named score_col, which is replaced).
    """
    small_batches(docs.sparkSession)
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32)))  # at most 2**BITS slots
    rest = [c for c in docs.columns if c != score_col] if keep else []
    source = docs.select(*rest) if keep else two(docs, id_col, text_col)
    at = rest.index(text_col) if keep else 1

    def build(batches: Iterator[pa.RecordBatch]):
        w = np.zeros(BIAS + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            for part, data, offsets in pieces(batch, batch.schema.names[at]):
                text, slot, value = features(data, offsets)
                logit = np.bincount(text, w[slot] * value, part.num_rows)
                out = pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
                yield pa.RecordBatch.from_arrays([*(part.columns if keep else part.columns[:1]), out], [*(part.schema.names if keep else ["doc_id"]), score_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) if keep else "doc_id long"
    return source.mapInArrow(build, f"{kinds}, `{score_col}` double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stage: documents scored under KEEP_AT go. Each row is judged by its own text, whatever its id; null texts are scored as empty ones; an empty table stays empty."""
    original = read(spark, sf_dir, "documents")
    weights = train(original, read(spark, sf_dir, "labels"))
    name = unused("score", docs.columns)
    return score(docs, weights, keep=True, score_col=name).where(F.col(name) >= KEEP_AT).select(*docs.columns)
