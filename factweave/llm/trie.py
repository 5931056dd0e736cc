"""Conversation prefix trie (12) by truncation peeling.

From the deepest level up, the conversations that end at a level are merged with the nodes that
survive from below; each node is then counted, stripped of its last turn and grouped anew, so nodes
are found and added up in the same pass.

A job for each level would take as many jobs as the longest conversation has turns. So paths (16
bytes a turn) are sorted and dealt out by ranges, and each task peels its range through all levels.
A range is a connected part of the trie: only nodes on its first and its last path can have
members elsewhere. Those two paths, with what they have counted so far, are all that a task leaves
open; they are peeled again, in ever fewer ranges, until none is open. Neither a common first turn nor
a conversation of which there are very many copies lands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, read, saved, small_enough

#: Bytes of paths in one range.
RANGE_BYTES = 16 << 20
#: Open paths (and bytes of them) that one task peels.
LAST_PATHS, LAST_BYTES = 4096, 64 << 20
#: Open nodes are broadcast up to this count (24 bytes each); beyond it the join shuffles.
BROADCAST_NODES = 1_000_000
#: Ids in one row of a list that is hashed later.
IDS = 1 << 20
ROOT = bytes(16)

_ROWS = (
    "kind int, key binary, depth long, conv_id long, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "keys binary, chars binary, counts binary, first long, ids binary"
)
_NAMES = _ROWS.replace(",", "").split(" ")[::2]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x] for x in _ROWS.replace(",", "").split(" ")[1::2]]
#: Kinds of rows that a task makes.
NODE, OPEN, ENDS = range(3)
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text): a digest and the code points of each turn, in order.

    Null turns come first; turns of one number go by their digest. A null role or text is empty. Rows
    without a conv_id belong to no conversation. A conversation is one row, 60 bytes a turn.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256), 1, 32)
    each = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("turn"))
    ordered = F.sort_array(F.collect_list("turn"))
    return each.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def _chain(path: bytes) -> list[bytes]:
    """The keys of a path's nodes, the root's first: each is a digest of the one before it and of a turn."""
    keys = [ROOT]
    for i in range(0, len(path), 16):
        keys.append(hashlib.blake2b(keys[-1] + path[i : i + 16], digest_size=16).digest())
    return keys


@dataclass(slots=True)
class Node:
    """A node as far as it is counted; keys and chars are those of a path through it."""

    keys: list[bytes]
    chars: np.ndarray
    n: int
    least: int
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ended: np.ndarray | None = None

    def take(self, other: Node) -> None:
        self.n, self.least = self.n + other.n, min(self.least, other.least)
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        if other.ended is not None:
            self.ended = other.ended if self.ended is None else np.concatenate((self.ended, other.ended))


def _sha(ids: np.ndarray | None) -> str:
    return hashlib.sha256(b"" if ids is None else ",".join(map(str, np.sort(ids).tolist())).encode()).hexdigest()


def peel(ended: dict[int, list[Node]], opened: set[bytes]) -> Iterator[tuple[Node, int, int | None]]:
    """(node, depth, its parent's least member) of the nodes that aren't open, from the deepest level up; those with an open parent have None.

    ended: what ends at each depth. What open nodes have counted stays in `ended`, one node each.
    """
    level: dict[bytes, Node] = {}
    below: list[Node] = []
    for depth in range(max(ended, default=0), -1, -1):
        for node in ended.pop(depth, ()):
            if (there := level.setdefault(node.keys[depth], node)) is not node:
                there.take(node)
        for node in below:
            parent = node.keys[depth]
            yield node, depth + 1, None if parent in opened else level[parent].least
        below, up = [], {}
        for key, node in level.items():
            if key in opened:
                ended.setdefault(depth, []).append(node)
                continue
            node.leaves += node.children == 0
            node.saved += (node.n - 1) * int(node.chars[depth])
            below.append(node)
            if depth:
                stripped = Node(node.keys, node.chars, node.n, node.least, 1, node.leaves, node.saved)
                if (there := up.setdefault(node.keys[depth - 1], stripped)) is not stripped:
                    there.take(stripped)
        level = up
    for node in below:
        yield node, 0, None


def _told(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _peeled(ended: dict[int, list[Node]], edges: list[tuple[list[bytes], np.ndarray]], hashed: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes, of the open paths (edges) and of the ids that end at open nodes."""
    opened = {key for keys, _ in edges for key in keys}
    rows: list[dict] = []
    for node, depth, parent in peel(ended, opened):
        rows.append(
            {"kind": NODE, "key": node.keys[depth], "depth": depth, "conv_id": node.least, "parent_key": node.keys[depth - 1] if depth and parent is None else None, "parent_conv_id": parent}
            | {"n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": _sha(node.ended) if hashed else None}
        )
        if len(rows) >= 4096:
            yield _told(rows)
            rows = []
    left = {node.keys[depth]: node for depth, nodes in ended.items() for node in nodes}
    for keys, chars in edges:
        counts = np.zeros((5, len(keys)), np.int64)
        for depth, key in enumerate(keys):
            if (node := left.pop(key, None)) is None:
                counts[1, depth] = np.iinfo(np.int64).max
                continue
            counts[:, depth] = node.n, node.least, node.children, node.leaves, node.saved
            ids = np.zeros(0, np.int64) if node.ended is None else np.sort(node.ended)
            rows += [{"kind": ENDS, "key": key, "first": int(ids[i]), "ids": ids[i : i + IDS].tobytes()} for i in range(0, len(ids), IDS)]
        rows.append({"kind": OPEN, "keys": b"".join(keys), "chars": chars.tobytes(), "counts": counts.tobytes()})
    if rows:
        yield _told(rows)


def _first_peel(batches: Iterator[pa.RecordBatch]):
    """A range of (path, chars, conv_id), in order. Equal paths become one ended node."""
    ended: dict[int, list[Node]] = {}
    edges: list[tuple[list[bytes], np.ndarray]] = []
    path, chars, ids = None, None, []

    def closed() -> None:
        keys = _chain(path)
        mine = np.array(ids, np.int64)
        at = np.concatenate(([0], chars)).astype(np.int64)
        ended.setdefault(len(keys) - 1, []).append(Node(keys, at, len(mine), int(mine.min()), ended=mine))
        edges[1:] = [(keys, at)]  # the first path stays, the second is the last so far

    for batch in batches:
        for now, sizes, conv_id in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if now != path:
                if path is not None:
                    closed()
                path, chars, ids = now, sizes.values.to_numpy(zero_copy_only=False), []
            ids.append(conv_id)
    if path is not None:
        closed()
        yield from _peeled(ended, edges, True)


def _next_peel(last: bool):
    """A range of open paths, in order of their keys; nothing stays open in the last."""

    def build(batches: Iterator[pa.RecordBatch]):
        ended: dict[int, list[Node]] = {}
        edges: list[tuple[list[bytes], np.ndarray]] = []
        for batch in batches:
            for keys, chars, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = [keys[i : i + 16] for i in range(0, len(keys), 16)]
                chars = np.frombuffer(chars, np.int64)
                for depth, (n, least, *more) in enumerate(np.frombuffer(counts, np.int64).reshape(5, -1).T.tolist()):
                    ended.setdefault(depth, []).append(Node(keys, chars, n, least, *more))
                if not last:
                    edges[1:] = [(keys, chars)]
        if ended:
            yield from _peeled(ended, edges, False)

    return build


def _hash_ids(batches: Iterator[pa.RecordBatch]):
    """The digest of each key's ids; rows come by key and first id, so that a list is read as a stream."""
    now, state = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
            if key != now:
                if now is not None:
                    keys.append(now)
                    digests.append(state.hexdigest())
                now, state = key, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), as `conversations` gives them: each distinct sequence of first turns.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 as the
    contract has them. A node's text is that of the first `depth` turns of conversation conv_id. Conversations
    without turns are members of the root; without any conversation there is no node. Ids are expected to be distinct.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = saved(convs.select(path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id"), "trie-paths")
    parts = max(paths.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(paths.select("path")) // RANGE_BYTES))
    rows = saved(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_first_peel, _ROWS), "trie-nodes")
    nodes = rows.where(F.col("kind") == NODE)
    chunks = rows.where(F.col("kind") == ENDS).select("key", "ids", "first")
    ends = chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hash_ids, "key binary, ends_sha256 string")

    opened = None
    while True:
        paths = rows.where(F.col("kind") == OPEN).select("keys", "chars", "counts")
        n, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("keys") + F.length("counts")), F.lit(0))).first()
        parts = -(-n // LAST_PATHS) + size // LAST_BYTES
        last = parts < 2 or 2 * parts >= n  # what ranges leave open would be no less
        ordered = paths.coalesce(1) if last else paths.repartitionByRange(parts, "keys").sortWithinPartitions("keys")
        rows = saved(ordered.mapInArrow(_next_peel(last), _ROWS), "trie-nodes")
        more = rows.where(F.col("kind") == NODE)
        opened = more if opened is None else opened.unionByName(more)
        if last:
            break
    opened = opened.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    every = nodes.unionByName(opened, allowMissingColumns=True)
    parents = opened.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv"))
    if small_enough(parents, BROADCAST_NODES):
        parents = F.broadcast(parents)
    below = every.where("parent_key is not null").join(parents, F.col("parent_key") == F.col("above")).withColumn("parent_conv_id", F.col("above_conv"))
    return every.where("parent_key is null").select(*NODE_COLUMNS).unionByName(below.select(*NODE_COLUMNS))


def rebuilt(convs: DataFrame) -> DataFrame:
    """The contract's conversations: c's first turns, as many as crc32(c) % 6, give way to those of conversation c - c % 100."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    donors = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("donor"), F.slice("turns", 1, 5).alias("lead"))
    joined = convs.join(donors, F.col("conv_id") - F.col("conv_id") % 100 == F.col("donor"), "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), h), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(lead, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(saved(conversations(read(spark, sf_dir, "conversations")), "conversations")))


#: DuckDB has no crc32: a table of its remainders, from the bits of the polynomial.
OP12_SQL = r"""
WITH RECURSIVE step(b, i, x) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM step WHERE i < 8),
remainders AS (SELECT b, x FROM step WHERE i = 8),
ids AS MATERIALIZED (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, x) AS (SELECT c, s, 0, 4294967295::BIGINT FROM ids UNION ALL
  SELECT c, s, i + 1, xor(crc.x >> 8, r.x) FROM crc JOIN remainders r ON r.b = xor(crc.x & 255, ascii(substr(s, i + 1, 1))) WHERE i < length(s)),
heads AS (SELECT c, xor(x, 4294967295) % 6 AS h FROM crc WHERE i = length(s)),
own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')), 1, 32)) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
built AS MATERIALIZED (SELECT o.c, list_concat(coalesce(d.w, [])[1 : h], o.w[h + 1 :]) AS w FROM own o JOIN heads USING (c) LEFT JOIN own d ON d.c = o.c - o.c % 100),
prefixes AS (SELECT c, len(w) AS n, d, w[1 : d] AS p FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM built)),
nodes AS MATERIALIZED (SELECT d, p, count(*) AS n, min(c) AS c, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM prefixes GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
told AS MATERIALIZED (SELECT x.*, coalesce(k.n, 0) AS kids, CASE WHEN x.d > 0 THEN (x.n - 1) * length(x.p[x.d].t) ELSE 0 END AS own FROM nodes x LEFT JOIN kids k ON k.d = x.d AND k.p = x.p),
subtree AS (SELECT d, p, sum(own) AS saved, sum(leaf) AS leaves FROM (SELECT unnest(range(d + 1)) AS d, p[1 : unnest(range(d + 1))] AS p, own, (kids = 0)::INTEGER AS leaf FROM told) GROUP BY 1, 2)
SELECT t.c AS conv_id, t.d AS depth, u.c AS parent_conv_id, t.n AS n_convs, t.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN subtree s ON s.d = t.d AND s.p = t.p LEFT JOIN nodes u ON u.d = t.d - 1 AND u.p = t.p[1 : t.d - 1]
"""
