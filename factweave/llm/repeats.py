"""Substring dedup (6) by fixed-block anchors.

A repeat of WINDOW words, wherever it starts, holds a whole block of BLOCK words of either
document, as blocks start at each multiple of BLOCK and WINDOW >= 2 * BLOCK - 1. Blocks are the
index; every rolling window of BLOCK words is a probe. Index and probes meet in buckets of the
hash, packed as numbers, never as a row for each. Stretches of SEGMENT words with a hit in
another document are extended: their windows of WINDOW words are matched, and adjoining
matches make up the maximal repeats, whose words go from all but the smallest document.

Hashes only find stretches. Windows that are removed are matched by 96 bits of keyed digests (and
those that choose the bucket); the key is drawn anew for each run, so no text can be written to match.

A window that two documents have which are read together is a hit there and then, and sends no
probe; of a block's documents only the smallest and the largest id are sent, of a window's
only the smallest. So however common a passage, it comes to its bucket once from each part of
the input, and a bucket's task holds one entry for each distinct window.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, read, saved, small_enough, two, unused
from .words import SPACES, Words, classes, pieces, strong, windows

WINDOW, BLOCK, SEGMENT = 50, 25, 1024
#: Bytes of input for each bucket, so that a bucket's index is a few MB at any size of input.
BUCKET_BYTES = 16 << 20
#: Ids are broadcast up to this count (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
_TABLE = classes(SPACES)
#: 96 bits of a window's digests.
_DIGEST = np.dtype([("high", "<u8"), ("low", "<u4")])

_PACKED = "bucket int, kind int, docs binary, texts binary, counts binary, hashes binary, places binary"
_NAMES = _PACKED.replace(",", "").split(" ")[::2]
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n])) if n else np.zeros(1, np.int64)


def _pack(bucket: np.ndarray, kind: int, owner: np.ndarray, ids: np.ndarray, texts: np.ndarray | None, hashes: np.ndarray | None, places: np.ndarray | None, rows: list[list]) -> None:
    """Adds a row for each bucket: its items by owner, as the owners' ids and counts and the items' numbers."""
    order = np.argsort(bucket.astype(np.int16) if len(bucket) and int(bucket.max()) < 32768 else bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    cuts = _runs(bucket)
    groups = _runs(bucket, owner)
    counts = np.diff(groups).astype(np.uint32)
    who = owner[groups[:-1]]
    inner = np.searchsorted(groups, cuts)
    hashes = None if hashes is None else hashes[order]
    places = None if places is None else places[order].astype(np.uint32)
    for i in range(len(cuts) - 1):
        a, b, g, h = int(cuts[i]), int(cuts[i + 1]), int(inner[i]), int(inner[i + 1])
        rows.append([int(bucket[a]), kind, ids[who[g:h]].tobytes(), b"" if texts is None else texts[who[g:h]].tobytes(), counts[g:h].tobytes(), b"" if hashes is None else hashes[a:b].tobytes(), b"" if places is None else places[a:b].tobytes()])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _rolled(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place in the text of each window of k words."""
    hashes = windows(words.hashes(), k)
    inside, of = _inside(words, k)
    return hashes[inside], of, inside - words.first[of]


def _inside(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and text number of each window of k words that one text has."""
    of, n = np.repeat(np.arange(len(words.first) - 1), words.counts()), max(0, len(words) - k + 1)
    inside = np.flatnonzero(of[:n] == of[k - 1 : k - 1 + n])
    return inside, of[inside]


def _offer(buckets: int):
    """Blocks (kind 0) and probes (kind 1): 32 bits of each hash within its bucket. Kind 2: stretches that need no probe."""

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in pieces(batch):
                hashes, of, place = _rolled(Words(data, offsets, _TABLE, lower=False), BLOCK)
                if not len(hashes):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                wide = len(data) > SEGMENT and bool((place >= SEGMENT).any())
                stretch, owner = np.unique(np.stack([of, place // SEGMENT]), axis=1, return_inverse=True) if wide else (np.stack([np.arange(len(ids)), np.zeros(len(ids), np.int64)]), of)
                owner = owner.ravel()
                bucket, low = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), hashes.astype(np.uint32)
                order = np.argsort(hashes, kind="stable")
                edge = _runs(hashes[order])
                who = ids[of[order]]
                shared = np.repeat(np.minimum.reduceat(who, edge[:-1]) != np.maximum.reduceat(who, edge[:-1]), np.diff(edge))
                first = np.zeros(len(hashes), bool)
                first[order[_runs(hashes[order], owner[order])[:-1]]] = True
                first[order[shared]] = False
                rows: list[list] = []
                block = np.flatnonzero(place % BLOCK == 0)
                block = block[np.lexsort((ids[of[block]], hashes[block]))]
                ends = _runs(hashes[block])
                block = np.sort(block[np.unique(np.concatenate((ends[:-1], ends[1:] - 1)))]) if len(block) else block
                _pack(bucket[block], 0, of[block], ids, None, low[block], None, rows)
                _pack(bucket[first], 1, owner[first], ids[stretch[0]], stretch[1], low[first], None, rows)
                if len(known := np.unique(owner[order[shared]])):
                    rows.append([int(known[0] + ids[0]) % buckets, 2, ids[stretch[0][known]].tobytes(), stretch[1][known].tobytes(), b"", b"", b""])
                yield _batch(rows)

    return build


def _probe(batches: Iterator[pa.RecordBatch]):
    """Stretches with a window that is a block of another document. Rows come by bucket, blocks first; only blocks are held."""
    now, kept, index = None, [], None
    for batch in batches:
        found_docs, found_at = [], []
        for bucket, kind, docs, stretch, counts, low in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if bucket != now:
                now, kept, index = bucket, [], None
            ids = np.frombuffer(docs, np.int64)
            if kind == 2:
                found_docs.append(ids)
                found_at.append(np.frombuffer(stretch, np.int64))
                continue
            of = np.repeat(np.arange(len(ids)), np.frombuffer(counts, np.uint32))
            low = np.frombuffer(low, np.uint32)
            if kind == 0:
                kept.append((low, ids[of]))
                if len(kept) >= 256:
                    kept = [_condense(kept)]
                continue
            if index is None and kept:
                low0, id0 = _condense(kept)
                at = _runs(low0)[:-1]
                index, kept = (low0[at], id0[at], np.maximum.reduceat(id0, at)), []
            if index is None:
                continue
            place = np.searchsorted(index[0], low)
            place[place == len(index[0])] = 0
            hit = (index[0][place] == low) & ((index[1][place] != ids[of]) | (index[2][place] != ids[of]))
            if hit.any():
                who = np.unique(of[hit])
                found_docs.append(ids[who])
                found_at.append(np.frombuffer(stretch, np.int64)[who])
        if found_docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_docs)), pa.array(np.concatenate(found_at))], ["doc_id", "stretch"])


def _condense(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (hash, id), of each hash the smallest and the largest id only."""
    low, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, low))
    low, ids = low[order], ids[order]
    edge = _runs(low)
    keep = np.unique(np.concatenate((edge[:-1], edge[1:] - 1)))
    return low[keep], ids[keep]


def _extend(buckets: int, key: bytes):
    """Windows of WINDOW words in the stretches: known repeats within the part (bucket < 0), the rest for a look at all."""

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in pieces(batch):
                words = Words(data, offsets, _TABLE, lower=False)
                inside, of = _inside(words, WINDOW)
                if not len(inside):
                    continue
                place = inside - words.first[of]
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                texts = part.column("text_id").to_numpy().astype(np.int64)
                wide = int(place.max()) // SEGMENT + 2
                marked = np.zeros((len(ids), wide), bool)
                for i, x in enumerate(part.column("stretches").to_pylist()):
                    marked[i, [s for s in x if s < wide]] = True
                near = marked[of, place // SEGMENT] | marked[of, (place + BLOCK) // SEGMENT]
                inside, of, place = inside[near], of[near], place[near]
                if not len(inside):
                    continue
                digests = np.empty(len(inside), _DIGEST)
                high, low = strong(words, WINDOW, key)
                digests["high"], digests["low"] = high[inside], low[inside].astype(np.uint32)
                order = np.lexsort((ids[of], digests["low"], digests["high"]))
                edge = _runs(digests["high"][order], digests["low"][order])
                least = np.empty(len(inside), np.int64)
                least[order] = np.repeat(ids[of[order[edge[:-1]]]], np.diff(edge))
                later = ids[of] > least
                bucket = ((low[inside] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                rows: list[list] = []
                _pack(bucket[~later], 0, of[~later], ids, texts, digests[~later], place[~later], rows)
                _pack(-1 - (of[later] % buckets), 1, of[later], ids, texts, None, place[later], rows)
                yield _batch(rows)

    return build


#: Windows of a bucket that are looked at together, at least.
SETTLE = 1 << 17


def _settle(batches: Iterator[pa.RecordBatch]):
    """Places of windows that start in a document of smaller id too. Of each distinct window only those in the smallest document so far are held."""

    def settled(held: list[tuple]) -> tuple[tuple, tuple]:
        """(the windows in their smallest document, the others), each as ids, texts, hashes, places."""
        ids, texts, hashes, places = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((texts, ids, hashes["low"], hashes["high"]))
        edge = _runs(hashes["high"][order], hashes["low"][order])
        least = np.empty(len(hashes), np.int64)
        least[order] = np.repeat(ids[order[edge[:-1]]], np.diff(edge))
        later = ids > least
        return tuple(x[~later] for x in (ids, texts, hashes, places)), tuple(x[later] for x in (ids, texts, hashes, places))

    def told(ids, texts, _, places):
        order = np.lexsort((places, texts, ids))
        ids, texts, places = ids[order], texts[order], places[order]
        cuts = _runs(ids, texts)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(ids[a]), int(texts[a]), places[a:b].astype(np.uint32).tobytes()

    def emit(ids, texts, of, places):
        cuts = _runs(of)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(ids[of[a]]), int(texts[of[a]]), places[a:b].astype(np.uint32).tobytes()

    def rows():
        now, held, kept, size = None, [], 0, 0
        for batch in batches:
            for bucket, _, docs, text_ids, counts, hashes, places in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held and (bucket != now or size >= max(SETTLE, 2 * kept)):
                    least, others = settled(held)
                    yield from told(*others)
                    held, kept = ([], 0) if bucket != now else ([least], len(least[0]))
                    size = kept
                now = bucket
                ids, texts = np.frombuffer(docs, np.int64), np.frombuffer(text_ids, np.int64)
                of = np.repeat(np.arange(len(ids)), np.frombuffer(counts, np.uint32))
                if bucket < 0:
                    yield from emit(ids, texts, of, np.frombuffer(places, np.uint32))
                else:
                    held.append((ids[of], texts[of], np.frombuffer(hashes, _DIGEST), np.frombuffer(places, np.uint32)))
                    size += len(of)
        if held:
            yield from told(*settled(held)[1])

    pending: list[tuple] = []
    for row in rows():
        pending.append(row)
        if len(pending) >= 2000:
            yield _found(pending)
            pending = []
    if pending:
        yield _found(pending)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "text_id", "places"])


def _plain(batches: Iterator[pa.RecordBatch]):
    """Words and digest of each text as it stands; bytes.split() parts at the same six characters."""
    for batch in batches:
        for part, data, offsets in pieces(batch):
            raw, counts, digests = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = raw[a:b].split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "text_id", "n_words", "kept_sha256"])


def kept_words(raw: bytes, places: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """The words of a text but for those that the windows at the places cover."""
    words = raw.split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~covered).tolist()]


def _without(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts, counts, digests = [], [], []
        for text, places in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
            kept = kept_words(text.as_py().encode(), np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in places])).astype(np.int64))
            texts.append(b" ".join(kept).decode())
            counts.append(len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "text_id", "new_text", "n_kept", "new_sha256"])


def repeated_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id, places of repeated windows, packed), several rows a text; and the texts with hits (doc_id, text_id, text, stretches)."""
    buckets = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    offered = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_offer(buckets), _PACKED)
    hits = saved(offered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_probe, "doc_id long, stretch long").distinct(), "repeat-hits")
    stretches = hits.groupBy("doc_id").agg(F.collect_set("stretch").alias("stretches"))
    wanted = docs
    if small_enough(ids := stretches.select("doc_id"), BROADCAST_IDS):
        wanted = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = saved(wanted.join(stretches, "doc_id"), "repeat-texts")
    windows = texts.mapInArrow(_extend(buckets, os.urandom(16)), _PACKED)
    return saved(windows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle, "doc_id long, text_id long, places binary"), "repeat-places"), texts


def changed_texts(source: DataFrame) -> DataFrame:
    """(doc_id, text_id, new_text, n_kept, new_sha256) of the texts of source (doc_id, text, text_id) that lose words: the kept ones, joined by one space."""
    places, texts = repeated_places(source)
    packed = places.groupBy("doc_id", "text_id").agg(F.collect_list("places").alias("places"))
    changed = texts.select("doc_id", "text_id", "text").dropDuplicates(["doc_id", "text_id"]).join(packed, ["doc_id", "text_id"])
    return changed.mapInArrow(_without, "doc_id long, text_id long, new_text string, n_kept long, new_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return two(docs, id_col, text_col).withColumn("text_id", F.xxhash64("text"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeats: a text that loses words becomes its kept words, joined by one space; all others stay as they are, as do the other columns.

    Nulls, rows without an id, repeated ids and empty tables are taken as by without_repeats.
    """
    names = docs.columns
    a, b, c = (unused(n, names) for n in ("key", "text_key", "new"))
    new = changed_texts(_source(docs, id_col, text_col)).select(F.col("doc_id").alias(a), F.col("text_id").alias(b), F.col("new_text").alias(c))
    joined = docs.join(new, (F.col(id_col).cast("long") == F.col(a)) & (F.xxhash64(F.col(text_col)) == F.col(b)), "left")
    return joined.select(*[F.coalesce(c, n).alias(n) if n == text_col else n for n in names])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs.

    A null text has no words. A row without an id neither loses words nor makes others lose
    any; rows of the same id don't either, among themselves. Texts under WINDOW words stay whole.
    An empty table gives none.
    """
    source = _source(docs, id_col, text_col)
    plain = source.mapInArrow(_plain, "doc_id long, text_id long, n_words long, kept_sha256 string")
    joined = plain.join(changed_texts(source).drop("new_text"), ["doc_id", "text_id"], "left")
    return joined.select("doc_id", "n_words", (F.col("n_words") - F.coalesce("n_kept", "n_words")).alias("n_removed"), F.coalesce("new_sha256", "kept_sha256").alias("kept_sha256"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, s, hash(array_to_string(w[s : s + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM p GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS i FROM p JOIN m USING (g) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
