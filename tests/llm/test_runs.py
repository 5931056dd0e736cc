"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from factweave.llm import queries, runs

SCHEMA = "doc_id long, text string, runs string, words int, n_words string"


def brute(words, length=6, exponent=4):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            part = words[i : i + size]
            least = next(p for p in range(1, size + 1) if all(part[k] == part[k + p] for k in range(size - p)))
            if least == q and size >= max(length, exponent * q):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def rebuilt(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def digests(doc_id, text):
    words = rebuilt(doc_id, text)
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def made(rng):
    kind = rng.randrange(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    if kind == 1:  # a root repeated, inside others
        root = [word(2) for _ in range(rng.randint(1, 6))]
        return [word(1) for _ in range(rng.randint(0, 9))] + root * rng.randint(2, 9) + root[: rng.randint(0, 6)] + [word(3) for _ in range(5)]
    if kind == 2:  # runs of runs
        inner = ["x"] * rng.randint(4, 7) + ["y"]
        return inner * rng.randint(3, 6) + ["x"] * 20
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(1, 5)):
            a, b = b, b + a
        return b * rng.randint(1, 5)
    return [word(4) for _ in range(rng.randint(0, 200))]


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (1, 2), (20, 3), (2, 2)])
def test_find_runs(length, exponent):
    rng = random.Random(length)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.randint(1, 6))]
        known = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = runs.find_runs(np.array([known[w] for t in texts for w in t], np.int64), first, length, exponent)
        want = [(int(first[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in brute(t, length, exponent)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


TEXTS = [None, "", " \n", "one", "a " * 6, "a " * 5, "a b " * 4, "a b a b a b a", "x" * 300 + " " + ("y" * 300 + " ") * 7, "é è " * 9, "z " * 5000, " ".join(str(i % 7) for i in range(3000))]


def test_rows(spark):
    """Nulls, blanks, long words, repeated ids, rows without an id and clashing columns; then the contract's columns."""
    rng = random.Random(5)
    rows = [(i % 150 if i else None, t if i < len(TEXTS) else " ".join(made(rng)), "x", 1, "y") for i, t in enumerate([*TEXTS, *[""] * 200])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = runs.periodic_runs(docs).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=str) == sorted(((i, len((t or "").encode().split()), brute((t or "").encode().split())) for i, t, *_ in rows), key=str)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i if i % 50 else None, t, "x", 1, "y") for i, t in enumerate([*TEXTS, *[" ".join(made(rng)) for _ in range(250)]])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(digests(i, t)) for i, t, *_ in rows)
