"""Exact top-k search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, score string, query long, packed int"


def brute(rows, asked, k):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if asked(i):
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(kept) if a != b)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_top_k(spark, monkeypatch, seed):
    """Nulls, values that aren't finite, repeated ids and vectors, lengths that differ, ties, and blocks of a few queries."""
    monkeypatch.setattr(top_k, "TILE", 16)
    monkeypatch.setattr(top_k, "DIMENSIONS", 4)
    rng = random.Random(seed)
    size, scale = rng.choice([(8, 1.0), (24, 1e-2), (11, 1e6)]), 1
    rows = [(rng.randrange(-20, 120), [rng.choice([0.5, -0.25, rng.gauss(0, size[1])]) for _ in range(size[0])]) for _ in range(150)]
    rows += [rows[0], rows[1], (10, None), (20, [None] * size[0]), (30, [float("nan")] * size[0]), (40, [float("inf")] * size[0]), (None, rows[0][1]), (50, []), (60, rows[2][1][:3]), (70, [*rows[3][1], 1.0])]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]
    docs = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    got = top_k.top_k(docs, F.col("vec_id") % 10 == 0, 5 + scale, block_bytes=rng.choice([200, 5000, 1 << 20]))
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 5 + scale)


def test_top_k_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0], None, None, None), (1, [2.0], None, None, None)], SCHEMA)
    assert [tuple(r) for r in top_k.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k.top_k(two.where("vec_id = 0"), F.lit(True)).count() == 0


def test_candidates_leave():
    """The bound spares products, and loses none of the best."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64)) * 100
    points = (centres[rng.integers(0, 40, 8000)] * np.geomspace(1, 0.02, 64) + rng.normal(size=(8000, 64))).astype(np.int32)
    asked, cuts = points[:1].astype(np.int64), list(range(0, 64, 16))
    best, spared = top_k.Best(1, 5), 0
    norms = top_k._rests(asked.T, cuts)
    for a in range(0, 8000, 1000):
        columns = points[a : a + 1000].T
        spared += top_k.look(asked, norms, cuts, best, slice(0, 1), np.arange(a, a + 1000), columns, top_k._rests(columns, cuts))
    scores = points.astype(np.int64) @ asked[0]
    want = np.lexsort((np.arange(8000), -scores))[:5]
    assert best.ids[0].tolist() == want.tolist() and best.scores[0].tolist() == scores[want].tolist()
    assert spared > 100_000
