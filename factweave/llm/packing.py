"""Packing (3): Karmarkar-Karp multiway differencing into near-equal windows.

Each document is its tokenizer's ids and an end id. Whole windows of SIZE ids are cut from it as
they are; what remains is cut into pieces of at most PIECE (here and there FINE) and packed. Within a group of pieces
the two partial partitions of largest imbalance are merged, the large sums of one onto the small
sums of the other, until one is left: its parts are the windows. If one exceeds SIZE, the number
of windows rises.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, two
from .tokens import encoder, public_path
from .words import pieces

SIZE, PIECE, END_ID = 2048, 682, 1
#: The rest of each so many documents is cut into pieces of at most so many ids, which level the windows.
FINE_EVERY, FINE = 40, 32
#: Windows of pieces that are packed together.
GROUP_WINDOWS = 128
#: Share of their ids that a group takes, so that levelling needs no window more.
LEVEL = 0.997
#: Sequences of one task; a task's numbers start at its partition's number times this.
TASK_SEQUENCES = 1 << 40


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: k parts of near-equal sums, as (sum, items); parts without items are left out."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k  # parts of b that must go onto parts of a
        if over <= 0:
            both = a + b
        else:  # both by falling sums: the last ones of a take the smallest of b
            low = b[len(b) - over :]
            both = a[: len(a) - over] + b[: len(b) - over] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], reversed(low), strict=True)]
        both.sort(key=lambda x: -x[0])
        gap = both[0][0] - (both[-1][0] if len(both) >= k else 0)
        heapq.heappush(heap, (-gap, i, both))
    return heap[0][2] if heap else []


def windows_of(sizes: list[int], size: int = SIZE) -> list[list[int]]:
    """Items of each window; the window count rises until none exceeds size. No item may exceed it."""
    k = max(1, -(-sum(sizes) // size))
    while True:
        parts = difference(sizes, k)
        if not parts or parts[0][0] <= size:
            return [items for _, items in parts]
        k += max(1, k // 100)


def cut(n: int, size: int = SIZE, piece: int = PIECE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's whole windows, and of the pieces left, near-equal."""
    whole = [(i, size) for i in range(0, n - size + 1, size)]
    at, rest = n - n % size, n % size
    parts = -(-rest // piece)
    edges = [at + rest * i // parts for i in range(parts + 1)] if parts else []
    return whole, [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_KINDS = [*[pa.int64()] * 7, pa.binary()]


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: its document, place, length, digest, its sequence and offset there, and with with_ids its ids, 16 bits each.

    Groups are packed where their documents are read, so nothing is shuffled and no group spans
    tasks; sequence numbers are unique and the same when a task runs again. A null text is empty:
    one piece, the end id. Rows stay apart whatever their ids; an empty table gives none.
    """
    path = tokenizer or public_path("word_bpe_49k.json")

    def build(batches: Iterator[pa.RecordBatch]):
        encode, sequence = encoder(path), TaskContext.get().partitionId() * TASK_SEQUENCES
        waiting: list[tuple] = []
        held = number = 0
        out: list[tuple] = []

        def settle(most: float = np.inf):
            nonlocal sequence, waiting, held
            carried = []
            while held > most:
                carried.append(waiting.pop())
                held -= carried[-1][2]
            for items in windows_of([w[2] for w in waiting]):
                offset = 0
                for w in (waiting[i] for i in sorted(items)):
                    out.append((*w[:5], sequence, offset, w[5]))
                    offset += w[2]
                sequence += 1
            waiting = carried[::-1]
            held = sum(w[2] for w in waiting)

        for batch in batches:
            for part, data, offsets in pieces(batch):
                ids, counts = encode.encode(data, offsets)
                at = 0
                for doc, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    raw = np.append(ids[at : at + n], END_ID).astype("<u2")
                    at += n
                    whole, rest = cut(n + 1, piece=PIECE if number % FINE_EVERY else FINE)
                    number += 1
                    for a, m in whole:
                        piece = raw[a : a + m]
                        out.append((doc, a, m, zlib.crc32(piece.astype("<u4")), n + 1, sequence, 0, piece.tobytes() if with_ids else None))
                        sequence += 1
                    for a, m in rest:
                        piece = raw[a : a + m]
                        waiting.append((doc, a, m, zlib.crc32(piece.astype("<u4")), n + 1, piece.tobytes() if with_ids else None))
                        held += m
                    if held >= GROUP_WINDOWS * SIZE:
                        settle(GROUP_WINDOWS * SIZE * LEVEL)
                if out:
                    yield _rows(out)
                    out = []
        settle()
        if out:
            yield _rows(out)

    packed = two(docs, id_col, text_col).mapInArrow(build, SCHEMA)
    return packed if with_ids else packed.drop("ids")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], SCHEMA.replace(",", "").split(" ")[::2])


def sequences(packed: DataFrame, pad_id: int = 0, size: int = SIZE) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pack(with_ids=True): each sequence's pieces in order, padded to `size` ids but where their number is a power of two.

    A sequence is at most `size` ids, so its group is small. An empty table gives none.
    """
    pieces_ = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(F.transform(pieces_, lambda x: x["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    n = F.col("n_tokens")
    padded = F.concat("ids", F.substring(F.unhex(F.repeat(F.lit(np.array([pad_id], "<u2").tobytes().hex()), F.lit(size))), F.lit(1), 2 * (size - n).cast("int")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
    return whole.select("sequence_id", "n_tokens", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(padded).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the packed pieces with their ids. Null texts are empty ones; rows stay apart whatever their ids; an empty table gives none."""
    return pack(docs, with_ids=True)
