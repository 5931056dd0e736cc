"""Token ids in binary files (4): frequency-ranked ids in byte-aligned code, control bytes apart.

A file holds some documents in ascending order: a head, the documents' ids and counts, the
vocabulary of the file from its most frequent id down (ties: the smaller id first), control bytes
and data bytes. An id is its rank in that vocabulary, in 1, 2 or 3 bytes; a control byte has the
lengths of four ids, two bits each. Decoding looks all four lengths up at once.

Files are cells of a Parquet table in the shared folder, so that Spark's committers put them on
any file system, once, whatever executors are lost; `export` writes them to a mounted folder.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_bytes, read, saved, small_enough, two
from .tokens import encoder, public_path
from .words import pieces

MAGIC, HEAD = b"FWTK0001", "<8sIIQQ"
END_ID = 2
#: Ids of a file; a longer document has a file of its own.
FILE_IDS = 1 << 20
#: Input bytes of one range of documents, and so of a task that writes files.
RANGE_BYTES = 8 << 20
BROADCAST_FILES = 1_000_000
#: Tasks whose ids are summed up together; 2**31 tasks are at most 500,000 such blocks, which are broadcast.
TASKS = 4096
NO_ID = -(1 << 63)

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    vocabulary = np.lexsort((np.arange(len(seen)), -seen))[: np.count_nonzero(seen)].astype(np.uint32)
    rank = np.zeros(len(seen), np.uint32)
    rank[vocabulary] = np.arange(len(vocabulary), dtype=np.uint32)
    ranks = rank[ids] if len(ids) else np.zeros(0, np.uint32)
    size = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for i in range(3):
        more = size > i
        data[at[more] + i] = ranks[more] >> 8 * i & 0xFF
    names = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join((struct.pack(HEAD, MAGIC, len(doc_ids), len(vocabulary), len(ids), len(data)), names.tobytes(), np.array(counts, "<u8").tobytes(), vocabulary.astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and all ids of a file."""
    magic, docs, words, n, size = struct.unpack_from(HEAD, raw)
    if magic != MAGIC:
        raise ValueError("no token file")
    at = struct.calcsize(HEAD)
    names = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
    vocabulary = np.frombuffer(raw, "<u4", words, at + 16 * docs)
    at += 16 * docs + 4 * words
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.concatenate((np.frombuffer(raw, np.uint8, size, at + len(control)), np.zeros(2, np.uint8)))
    lengths = _LENGTHS[control].ravel()[:n]
    place = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[place].astype(np.uint32)
    ranks |= np.where(lengths > 1, data[place + 1], 0).astype(np.uint32) << 8
    ranks |= np.where(lengths > 2, data[place + 2], 0).astype(np.uint32) << 16
    return [None if d == NO_ID else d for d in names.tolist()], counts, vocabulary[ranks] if n else np.zeros(0, np.uint32)


def export(files: DataFrame, folder: str) -> None:
    """Writes each file to a folder that all executors mount, named by its place in the order; a task that runs again writes the same."""

    def put(rows) -> None:
        for r in rows:
            path = os.path.join(folder, f"{r.task:08d}-{r.file_no:06d}.bin")
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r.file)
            os.replace(part, path)

    files.select("task", "file_no", "file").foreachPartition(put)


def write_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(task, file_no, n_docs, n_ids, file): the table of files, in ascending order of doc_id by (task, file_no).

    Documents go to ranges of ids, so files follow one another over the whole table. A null id
    comes first, rows of one id by text; a null text is empty and has the end id only. An empty
    table gives no files.
    """
    path = tokenizer or public_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(two(docs, id_col, text_col)) // RANGE_BYTES))

    def build(batches: Iterator[pa.RecordBatch]):
        encode, task = encoder(path), TaskContext.get().partitionId()
        names, counts, parts, held, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, counts, parts, held, number
            row = [task, number, len(names), held, encode_file(names, counts, np.concatenate(parts))]
            names, counts, parts, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["task", "file_no", "n_docs", "n_ids", "file"])

        for batch in batches:
            for part, data, offsets in pieces(batch):
                ids, sizes = encode.encode(data, offsets)
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                at = 0
                for doc, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                    if held and held + n > FILE_IDS:
                        yield flush()
                    names.append(doc)
                    counts.append(n)
                    parts.append(ids[at : at + n])
                    held, at = held + n, at + n
        if names:
            yield flush()

    # Rows of one id, or of none, are parted by how their texts begin.
    dealt = two(docs, id_col, text_col).repartitionByRange(ranges, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return saved(dealt.mapInArrow(build, "task int, file_no int, n_docs long, n_ids long, file binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files; start counts the ids of all documents before."""
    # Running sums over tasks: within blocks of tasks, and over the blocks (one row for each TASKS of them).
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("n")).withColumn("block", F.floor(F.col("task") / TASKS))
    blocks = tasks.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("block_start"))
    within = (F.sum("n").over(Window.partitionBy("block").orderBy("task")) - F.col("n")).alias("in_block")
    before = tasks.select("task", "block", within).join(F.broadcast(blocks), "block").select("task", (F.col("block_start") + F.col("in_block")).alias("task_start"))
    inner = Window.partitionBy("task").orderBy("file_no")
    starts = files.select("task", "file_no", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("inner")).join(before, "task").select("task", "file_no", (F.col("task_start") + F.col("inner")).alias("start"))
    if small_enough(files.select("task"), BROADCAST_FILES):
        starts = F.broadcast(starts)

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for raw, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                names, counts, ids = decode_file(raw.as_py())
                ends = np.cumsum(counts)
                begin = ends - counts
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begin + start, pa.int64()), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(starts, ["task", "file_no"]).select("file", "start").mapInArrow(build, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(read(spark, sf_dir, "documents")))
