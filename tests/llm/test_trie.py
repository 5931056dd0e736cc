"""The conversation prefix trie against brute force, in one range and in many."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, path string"


def ordered(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}:{t}".encode()).hexdigest()[:32]
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, digest(r, t)), (r, t)))
    return {c: [x for _, x in sorted(w)] for c, w in convs.items()}


def brute_rebuilt(convs):
    out = {}
    for c, w in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + w[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, w in convs.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    nodes = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        nodes.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


def made(seed):
    """Common first turns, many copies, one very long conversation, nulls, ties, repeated rows, and ids without a donor."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230)]:
        if c % 5 == 0:
            w = [("user", "hello"), ("assistant", "hi 😀")]
        else:
            w = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc"])) for _ in range(rng.randrange(1, 7))]
            w = [("user", "hello")] * (rng.random() < 0.5) + w
        rows += [(c, i if rng.random() < 0.9 else None, r, t) for i, (r, t) in enumerate(w)]
    rows += [(300, i, "user", f"turn {i}") for i in range(150)] + [(301, i, "user", f"turn {i}" if i < 120 else "other") for i in range(140)]
    return rows + [rows[0], rows[0], (None, 0, "user", "lost"), (400, None, None, None)]


@pytest.mark.parametrize(("seed", "ranges", "last"), [(1, 1, 4096), (2, 7, 4096), (3, 40, 4), (4, 23, 8)])
def test_trie(spark, monkeypatch, seed, ranges, last):
    monkeypatch.setattr(trie, "LAST_PATHS", last)
    monkeypatch.setattr(trie, "RANGE_BYTES", 1 << 40 if ranges == 1 else 1)
    monkeypatch.setattr(trie, "input_bytes", lambda _: ranges)
    monkeypatch.setattr(trie, "IDS", 3)
    rows = made(seed)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    convs = trie.rebuilt(trie.conversations(docs))
    want = brute_rebuilt(ordered(rows))
    got = trie.prefix_trie(convs)
    assert got.columns == trie.NODE_COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(want)


def test_trie_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.conversations(none)).count() == 0
    bare = spark.createDataFrame([(3, []), (5, [])], "conv_id long, turns array<struct<digest:string,chars:long>>")
    assert [tuple(r) for r in trie.prefix_trie(bare).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_open_paths_alone(spark, monkeypatch):
    """Each range leaves two paths open at most, so copies of one conversation are never gathered in one task."""
    monkeypatch.setattr(trie, "RANGE_BYTES", 1)
    monkeypatch.setattr(trie, "input_bytes", lambda _: 30)
    seen = []
    save = trie.saved
    monkeypatch.setattr(trie, "saved", lambda df, name: seen.append(save(df, name)) or seen[-1])
    docs = spark.createDataFrame([(i, 0, "user", "hello", 1, "x") for i in range(3000)], SCHEMA)
    nodes = trie.prefix_trie(trie.conversations(docs)).collect()
    assert len(nodes) == 2 and nodes[1].n_convs == 3000
    first = next(df for df in seen if "kind" in df.columns)
    ends = first.where(F.col("kind") == trie.ENDS).select(F.length("ids")).collect()
    assert len(ends) >= 20 and max(e[0] for e in ends) <= 8 * 400
