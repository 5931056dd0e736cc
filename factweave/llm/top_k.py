"""Exact top-k search (13) by columnar branch-and-bound.

Vectors are packed into tiles in vertical layout: all values of a dimension lie together. A block
of queries meets a tile dimension block by dimension block: inner products are added up, and
after each block the bound of what is left (the product of the rests' norms) tells which
candidates can still reach a query's k-th best score; the others leave the tile's columns.

Queries are taken in blocks of a fixed size in bytes. Each block is one pass over the tiles, in
which a task keeps k + 1 scores a query, so what a pass shuffles doesn't grow with the candidates
that a task has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, read, saved, unused

#: Vectors in one tile, and dimensions that are added up between two looks at the bound.
TILE, DIMENSIONS = 4096, 16
#: Bytes of the queries in one pass: what is broadcast.
BLOCK_BYTES = 16 << 20
#: Queries that are compared with a tile at once.
QUERIES = 256
#: A tile is compacted when this share of its candidates, or less, is left.
COMPACT = 0.7

_TILE = "n int, dims int, width int, ids binary, columns binary"
_FOUND = "query long, query_id long, self_score long, vec_id long, score long"


def whole_numbers(vector: str) -> Column:
    """floor(256 * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _width(most: int) -> int:
    return next(w for w in (2, 4, 8) if most < 1 << 8 * w - 1)


def _pack(batches: Iterator[pa.RecordBatch]):
    """Tiles of vectors of one length, their values by dimension in the narrowest type that holds them."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        values, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        sizes = np.diff(ends)
        rows = []
        for dims in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dims)
            for part in np.split(mine, range(TILE, len(mine), TILE)):
                data = values[ends[part][:, None] + np.arange(dims)].reshape(len(part), dims).T
                most = max(int(data.max()), -int(data.min())) if data.size else 0
                width = _width(most)
                rows.append({"n": len(part), "dims": dims, "width": width, "ids": ids[part].astype("<i8").tobytes(), "columns": np.ascontiguousarray(data.astype(f"<i{width}")).tobytes()})
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(["n", "dims", "width", "ids", "columns"], kinds, strict=True))))


def _tile(n: int, dims: int, width: int, ids: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and the values as (dimension, vector)."""
    return np.frombuffer(ids, "<i8"), np.frombuffer(columns, f"<i{width}").reshape(dims, n)


def _rests(columns: np.ndarray, cuts: list[int]) -> np.ndarray:
    """For each cut, the norm of each vector's values from there on, rounded up a little."""
    squares = np.add.reduceat(columns.astype(np.float64) ** 2, cuts, axis=0)
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1]) * (1 + 1e-9) + 1e-6


class Best:
    """The best scores of some queries so far: by score, greatest first, then by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def may(self, rows: slice, bounds: np.ndarray) -> np.ndarray:
        """Which of bounds (query, candidate) reach the query's last score."""
        return bounds >= self.scores[rows, -1:]

    def put(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in the scores (query, candidate) of candidates in rising order of their ids."""
        last = self.scores[rows, -1:]
        better = (scores > last) | ((scores == last) & (ids < self.ids[rows, -1:]))
        for i in np.flatnonzero(better.any(axis=1)).tolist():
            mine = np.flatnonzero(better[i])
            if len(mine) > 4 * self.k:  # the k-th best of them bounds what can stay
                edge = np.partition(scores[i, mine], len(mine) - self.k)[len(mine) - self.k]
                mine = mine[scores[i, mine] >= edge]
            s, d = np.concatenate((self.scores[rows.start + i], scores[i, mine])), np.concatenate((self.ids[rows.start + i], ids[mine]))
            order = np.lexsort((d, ~s))[: self.k]
            self.scores[rows.start + i], self.ids[rows.start + i] = s[order], d[order]


def look(queries: np.ndarray, norms: np.ndarray, cuts: list[int], best: Best, rows: slice, ids: np.ndarray, columns: np.ndarray, rests: np.ndarray) -> int:
    """Compares queries (query, dimension) with a tile; returns how many products were left out.

    norms, rests: (cut, query) and (cut, candidate). Sums are whole numbers, exact in the type used: those of
    absolute values are at most the product of the norms.
    """
    most = float(norms[0].max()) * float(rests[0].max())
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    q, c = queries.astype(kind), columns.astype(kind)
    sums, alive, spared = np.zeros((len(q), c.shape[1]), kind), np.arange(c.shape[1]), 0
    for j, a in enumerate(cuts):
        b = cuts[j + 1] if j + 1 < len(cuts) else len(c)
        sums += q[:, a:b] @ c[a:b]
        if j + 1 == len(cuts) or kind is np.int64:  # a bound in floating point would be too coarse there
            continue
        open_ = best.may(rows, sums + norms[j + 1][:, None] * rests[j + 1][alive]).any(axis=0)
        if open_.sum() <= COMPACT * len(open_):
            spared += int((~open_).sum()) * (len(c) - b) * len(q)
            alive, sums, c = alive[open_], sums[:, open_], c[:, open_]
            if not len(alive):
                return spared
    best.put(rows, sums.astype(np.int64), ids[alive])
    return spared


def _search(shared: Broadcast, k: int):
    def build(batches: Iterator[pa.RecordBatch]):
        first, asked, matrix = shared.value  # the first query's number, the queries' ids, their values
        best, dims = Best(len(asked), k), matrix.shape[1]
        order = np.argsort(-(matrix.astype(np.float64) ** 2).sum(axis=0), kind="stable")  # the dimensions with most mass first
        matrix = matrix[:, order]
        cuts = list(range(0, dims, DIMENSIONS)) or [0]
        norms = _rests(matrix.T, cuts) if dims else np.zeros((1, len(asked)))
        for batch in batches:
            for tile in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, columns = _tile(*tile)
                fitted = np.zeros((dims, len(ids)), columns.dtype)  # missing components count as 0
                both = min(dims, len(columns))
                fitted[:both] = columns[:both]
                by_id = np.argsort(ids, kind="stable")
                ids, columns = ids[by_id], fitted[order][:, by_id]
                rests = _rests(columns, cuts) if dims else np.zeros((1, len(ids)))
                for a in range(0, len(asked), QUERIES):
                    rows = slice(a, min(a + QUERIES, len(asked)))
                    look(matrix[rows], norms[:, rows], cuts, best, rows, ids, columns, rests)
        there = best.ids < np.iinfo(np.int64).max
        there |= best.scores > np.iinfo(np.int64).min
        of, _ = np.nonzero(there)
        own = np.einsum("ij,ij->i", matrix.astype(np.int64), matrix.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (first + of, asked[of], own[of], best.ids[there], best.scores[there])], ["query", "query_id", "self_score", "vec_id", "score"])

    return build


def _blocks(queries: DataFrame, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The queries, as many at once as limit bytes hold (as longs), and the first one's number: no more are on the driver at once."""
    held, size, first = [], 0, 0

    def block():
        dims = max(len(c) for _, c in held)
        whole = np.zeros((sum(len(i) for i, _ in held), dims), np.int64)
        at = 0
        for ids, columns in held:
            whole[at : at + len(ids), : len(columns)] = columns.T
            at += len(ids)
        return first, np.concatenate([i for i, _ in held]), whole

    for row in queries.toLocalIterator():
        ids, columns = _tile(*row)
        if held and size + 8 * columns.size + 8 * len(ids) > limit:
            yield block()
            first += sum(len(i) for i, _ in held)
            held, size = [], 0
        held.append((ids, columns))
        size += 8 * columns.size + 8 * len(ids)
    if held:
        yield block()


def top_k(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row of vectors where `asked` holds.

    The score is the inner product of floor(256 * x); components that the shorter vector lacks count
    as 0, and scores must fit a long. Ties go to the smaller id. Vectors that are null or hold a null or a component
    that isn't finite take no part, nor do rows without an id. Rows that repeat an id are queries and candidates
    each. Fewer rows than k give fewer ranks; an empty table none. block_bytes: of the queries in one pass.
    """
    name = unused("packed", vectors.columns)
    spark = vectors.sparkSession
    source = vectors.withColumn(name, asked).where(usable(vector_col) & F.col(id_col).isNotNull())
    source = source.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(vector_col).alias("vector"), F.coalesce(F.col(name), F.lit(False)).alias("asked"))
    bounded = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    try:
        tiles = saved(source.select("vec_id", "vector").mapInArrow(_pack, _TILE), "vector-tiles")
        queries = saved(source.where("asked").select("vec_id", "vector").mapInArrow(_pack, _TILE), "query-tiles")
        found = None
        for block in _blocks(queries, block_bytes):
            shared = spark.sparkContext.broadcast(block)  # block_bytes, or one tile
            one = saved(_ranked(tiles.mapInArrow(_search(shared, k + 1), _FOUND), k), "top-k")
            shared.destroy()
            found = one if found is None else found.unionByName(one)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch") if bounded is None else spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bounded)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all tasks. The query itself is one of the entries of its id and its own score, if it is among the best at all."""
    entry = F.struct((-F.col("score")).alias("less"), F.col("vec_id"))
    best = found.groupBy("query", "query_id", "self_score").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("best"))  # k + 1 entries a task
    own = F.array_position("best", F.struct((-F.col("self_score")).alias("less"), F.col("query_id").alias("vec_id"))) - 1
    others = F.slice(F.when(own < 0, F.col("best")).otherwise(F.filter("best", lambda x, i: i != own)), 1, k)
    ranks = best.select("query_id", F.posexplode(others))
    return ranks.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.less")).alias("score"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""
