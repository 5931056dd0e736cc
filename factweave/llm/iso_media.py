"""ISO base media files (9): boxes are walked, sample tables decoded; payloads are not.

`pack` stores bytes as 8-bit mono samples: a sample unit of 64 bytes, 16 units a chunk, the
first unit of each chunk a sync sample. `inspect` walks any file of nested boxes and gives for
its first track the codec, timescale, duration and byte ranges of keyframes; `payload` reads
the bytes that the sample tables point to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, saved, two

UNIT, UNITS_A_CHUNK, RATE = 64, 16, 8000
#: Boxes that hold boxes, as the format names them.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
_HEAD = full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0")
_MINF = full(b"smhd", bytes(4)) + box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
_ENTRY = box(b"raw ", bytes(6), struct.pack(">H8xHHIHH", 1, 1, 8, 0, RATE, 0))
_STSD = full(b"stsd", struct.pack(">I", 1), _ENTRY)


def pack(data: bytes) -> bytes:
    """The file that holds data, which must be a positive multiple of UNIT bytes long."""
    units, rest = divmod(len(data), UNIT)
    if rest or not units:
        raise ValueError(f"{len(data)} bytes aren't a positive multiple of {UNIT}")
    chunks = -(-units // UNITS_A_CHUNK)
    tail = units - (chunks - 1) * UNITS_A_CHUNK
    runs = [(1, UNITS_A_CHUNK, 1)] if tail == UNITS_A_CHUNK else [(1, UNITS_A_CHUNK, 1), (chunks, tail, 1)] if chunks > 1 else [(1, tail, 1)]
    wide = len(data) >= (1 << 32) - (1 << 20)
    mdat_head = 16 if len(data) + 8 >= 1 << 32 else 8
    sync = np.arange(chunks, dtype=np.int64) * UNITS_A_CHUNK + 1

    def moov(base: int) -> bytes:
        at = np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_A_CHUNK) + base
        stbl = box(
            b"stbl",
            _STSD,
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
            full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes()),
        )
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(data), 0x55C4, 0), version=1)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, len(data), 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, len(data), 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, _HEAD, box(b"minf", _MINF, stbl))))

    head = len(_FTYP) + len(moov(0)) + mdat_head
    return _FTYP + moov(head) + box(b"mdat", data)


def walk(data: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Each box's kind, the kind of the box around it, and where its content starts and ends; broken sizes end the walk of their level."""
    levels = [(0, len(data), b"")]
    while levels:
        start, end, outer = levels.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        yield kind, outer, start + head, start + size
        levels.append((start + size, end, outer))
        if kind in CONTAINERS:
            levels.append((start + head, start + size, kind))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    offsets: np.ndarray
    sync: np.ndarray


#: The sample tables that inspect reads.
TABLES = {b"stsd", b"stsc", b"stsz", b"stss", b"stco", b"co64"}


def inspect(data: bytes) -> Track | None:
    """The first track whose tables are whole and agree with one another and with the file; None if there is none (or data is no such file).

    No count of a table is taken for true before it is held against the bytes that are there.
    """
    tracks: list[dict] = []
    for kind, outer, a, b in walk(data):
        if kind == b"trak":
            tracks.append({})
        elif kind == b"mdhd" and tracks:
            tracks[-1][kind] = data[a:b]
        elif outer == b"stbl" and kind in TABLES and tracks:
            tracks[-1][kind] = data[a + 4 : b]
    for t in tracks:
        if {b"stsd", b"stsc", b"stsz"} <= set(t) and (b"stco" in t or b"co64" in t):
            try:
                return _track(t, len(data))
            except (struct.error, ValueError):  # cut or contradictory tables
                continue
    return None


def _track(t: dict[bytes, bytes], size: int) -> Track:
    sizes = _sizes(t[b"stsz"], size)
    offsets = _offsets(t, sizes)
    if len(offsets) and int((offsets + sizes).max()) > size:
        raise ValueError("a sample ends behind the file")
    head = t.get(b"mdhd", b"")
    time = (0, 0) if not head else struct.unpack_from(">IQ", head, 20) if head[0] == 1 else struct.unpack_from(">II", head, 12)
    if len(t[b"stsd"]) < 12 or time[1] >= 1 << 63:
        raise ValueError("no sample entry, or no duration")
    return Track(t[b"stsd"][8:12].decode("latin-1"), *time, sizes, offsets, _sync(t, len(sizes)))


def _numbers(raw: bytes, kind: str, skip: int, n: int) -> np.ndarray:
    if skip + n * np.dtype(kind).itemsize > len(raw):
        raise ValueError("a table is cut")
    found = np.frombuffer(raw, kind, n, skip)
    if kind == ">u8" and n and int(found.max()) >= 1 << 62:
        raise ValueError("a place behind any file")
    return found.astype(np.int64)


def _sizes(raw: bytes, size: int) -> np.ndarray:
    same, n = struct.unpack_from(">II", raw)
    if same * n > size:
        raise ValueError("more samples than bytes")
    return np.full(n, same, np.int64) if same else _numbers(raw, ">u4", 8, n)


def _offsets(tables: dict[bytes, bytes], sizes: np.ndarray) -> np.ndarray:
    """Each sample's place: its chunk's, and what comes before it in the chunk."""
    raw, kind = (tables[b"co64"], ">u8") if b"co64" in tables else (tables[b"stco"], ">u4")
    chunks = _numbers(raw, kind, 4, struct.unpack_from(">I", raw)[0])
    n = struct.unpack_from(">I", tables[b"stsc"])[0]
    runs = _numbers(tables[b"stsc"], ">u4", 4, 3 * n).reshape(n, 3)
    edges = np.append(runs[:, 0], len(chunks) + 1)
    if len(chunks) and (not n or edges[0] != 1) or (np.diff(edges) <= 0).any() and len(chunks):
        raise ValueError("runs of chunks out of order")
    per = np.repeat(runs[:, 1], np.diff(edges)) if len(chunks) else np.zeros(0, np.int64)
    if int(per.sum()) != len(sizes):
        raise ValueError("chunks and samples differ in number")
    first = np.concatenate(([0], np.cumsum(per)))
    of = np.repeat(np.arange(len(per)), per)
    before = np.concatenate(([0], np.cumsum(sizes)))
    return chunks[of] + before[: len(of)] - before[first[of]]


def _sync(tables: dict[bytes, bytes], n: int) -> np.ndarray:
    raw = tables.get(b"stss")
    if raw is None:  # without the table, all are sync samples
        return np.arange(n)
    return _numbers(raw, ">u4", 4, struct.unpack_from(">I", raw)[0]) - 1


def payload(data: bytes, track: Track) -> bytes:
    """The samples' bytes in order; samples that lie side by side are read at once."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    begin, stop = track.offsets[np.concatenate(([0], cut))], ends[np.concatenate((cut - 1, [len(ends) - 1]))]
    return b"".join(data[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True))


def keyframe_ranges(track: Track) -> list[tuple[int, int]]:
    at = track.sync[(track.sync >= 0) & (track.sync < len(track.offsets))]
    return list(zip(track.offsets[at].tolist(), (track.offsets[at] + track.sizes[at]).tolist(), strict=True))


def feature(track: Track) -> str:
    ranges = ",".join(f"{a}-{b}" for a, b in keyframe_ranges(track))
    return f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={ranges}"


MEDIA = "doc_id long, n_bytes long, media binary, codec string, timescale long, duration long, keyframes array<struct<start:long,stop:long>>"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), pack(raw + bytes(-len(raw) % UNIT if raw else UNIT))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its file and what its tables say: codec, timescale, duration, keyframes.

    A null text is stored as an empty one: one unit of zeros. Rows are neither joined nor
    merged, so repeated or null ids give a row each; an empty table gives no rows.
    """

    def build(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, media = _stored(text.as_py())
                track = inspect(media)
                rows.append({"doc_id": i, "n_bytes": n, "media": media, "codec": track.codec, "timescale": track.timescale, "duration": track.duration, "keyframes": [{"start": a, "stop": b} for a, b in keyframe_ranges(track)]})
            kinds = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("keyframes", pa.list_(kinds))]))

    return two(docs, id_col, text_col).mapInArrow(build, MEDIA)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the files in media_columns' media column, written to the shared folder and read again."""

    def build(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in batch.column(2):
                media = media.as_py()
                track = inspect(media)
                back = payload(media, track)
                for column, value in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], DIGESTS.replace(",", "").split(" ")[::2])

    stored = saved(media_columns(docs, id_col, text_col), "media")
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(build, DIGESTS)


#: What SQL can express of op9_media: the payload is the text's bytes and the padding.
PAYLOAD_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)
SELECT doc_id, n AS n_bytes, greatest(64, (n + 63) // 64 * 64) AS payload_bytes, sha256(encode(t) || unhex(repeat('00', (greatest(64, (n + 63) // 64 * 64) - n)::INTEGER))) AS payload_sha256 FROM d
"""


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_media that SQL can express."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read(spark, sf_dir, "documents"))
