"""Subtrees and phrases of tokens against a search from each root."""

import random

from factweave.operators import trees

SCHEMA = "doc_id long, sentence_index long, i int, text string, head int, dep string"


def below(heads, root, depth):
    seen, stack = {}, [(root, 0)]
    while stack:
        at, d = stack.pop(0)
        if at in seen or d > depth:
            continue
        seen[at] = d
        stack += [(c, d + 1) for c, h in enumerate(heads) if h == at]
    return sorted(seen)


def test_subtrees(spark):
    """Deep chains, cycles, own heads, heads outside, nulls, repeated texts and an empty table."""
    rng, rows, want, phrases = random.Random(1), [], {}, {}
    for s in range(40):
        n = rng.randrange(1, 25)
        heads = [rng.choice([i - 1, rng.randrange(-2, n + 2), i, None]) if s % 3 else i - 1 for i in range(n)]
        words, deps = [rng.choice(["a", "b", None]) for _ in range(n)], [rng.choice(["x", "y", None]) for _ in range(n)]
        rows += [(s % 4, s, i, words[i], heads[i], deps[i]) for i in range(n)]
        for r in range(n):
            found = below(heads, r, trees.DEPTH)
            want[s % 4, s, r] = (found, " ".join(words[i] or "" for i in found).strip())
            phrases[s % 4, s, r] = sorted({r, *(i for i in range(n) if heads[i] == r and deps[i] == "x")})
    rng.shuffle(rows)
    tokens = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {(r.doc_id, r.sentence_index, r.root): (r.indices, r.text) for r in trees.subtrees(tokens).collect()} == want
    assert {(r.doc_id, r.sentence_index, r.root): r.indices for r in trees.phrases(tokens, ("x",)).collect()} == phrases
    assert trees.subtrees(tokens.where("false")).count() == trees.phrases(tokens.where("false")).count() == 0


def test_subtrees_of_many_sentences_in_small_pieces(monkeypatch):
    """Pieces end inside a batch and inside a sentence's listing; places with wide gaps keep to the plain rules."""
    import pyarrow as pa

    monkeypatch.setattr(trees, "TOKENS", 7)
    monkeypatch.setattr(trees, "LISTED", 5)
    rng, sentences, want = random.Random(2), [], []
    for s in range(30):
        heads = [rng.choice([i - 1, rng.randrange(-2, 14), None]) for i in range(rng.randrange(1, 12))]
        sentences.append([{"i": i, "text": f"w{i}", "head": h} for i, h in enumerate(heads)])
        want += [(s, None, r, found, " ".join(f"w{i}" for i in found)) for r in range(len(heads)) for found in [below(heads, r, trees.DEPTH)]]
    sentences.append([{"i": -5, "text": "a", "head": 0}, {"i": 2**31 - 1, "text": " b ", "head": 1}])
    want += [(30, None, -5, [-5], "a"), (30, None, 2**31 - 1, [2**31 - 1], "b")]
    t = pa.array(sentences, pa.list_(pa.struct([("i", pa.int32()), ("text", pa.string()), ("head", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(31), pa.int64()), pa.array([None] * 31, pa.int32()), t], ["doc_id", "sentence_index", "t"])
    got = [tuple(r.values()) for b in trees._below(trees.DEPTH)(iter([batch])) for r in b.to_pylist()]
    assert got == want
