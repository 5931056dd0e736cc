"""Words and windows are told apart by what they are, also where their hashes agree."""

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import decontaminate, neardup, repeats, words
from factweave.llm.words import SPACES, Words, buffers, classes, mix, strong, told_apart, windows

TABLE = classes(SPACES)


def unmix(x):
    """The inverse of mix."""
    top = (1 << 64) - 1
    unshift = lambda v, k: v ^ v >> k ^ v >> 2 * k ^ (v >> 3 * k if 3 * k < 64 else 0)
    x = unshift(x, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) & top
    x = unshift(x, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & top
    return unshift(x, 30)


def twin(word: str) -> str:
    """Another word of letters and digits with the same hash, found as the hash is made: its last eight bytes undo another head."""
    import random

    rng, raw = random.Random(1), word.encode()
    assert 8 < len(raw) <= 16
    tail = int.from_bytes(raw[8:].ljust(8, b"\0"), "little")
    salt = len(raw) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    hashed = lambda head: int(mix(np.array([int.from_bytes(head, "little") ^ salt], np.uint64))[0])
    state, letters = hashed(raw[:8]), [ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    good = set(letters)
    while True:
        heads = np.array([rng.choices(letters, k=8) for _ in range(200_000)], np.uint8)
        tails = (mix(heads.view("<u8").ravel() ^ np.uint64(salt)) ^ np.uint64(state) ^ np.uint64(tail)).view(np.uint8).reshape(-1, 8)
        fits = np.isin(tails[:, : len(raw) - 8], list(good)).all(axis=1) & (tails[:, len(raw) - 8 :] == 0).all(axis=1)
        for i in np.flatnonzero(fits).tolist():
            return (heads[i].tobytes() + tails[i, : len(raw) - 8].tobytes()).decode()


def of(*texts, lower=False):
    return Words(*buffers(pa.array(texts)), TABLE, lower)


PAIR = ("internationalize", "urwm0jpmlcuco13x")


def test_unmix():
    for x in (0, 1, 12345678901234567890, (1 << 64) - 1):
        assert unmix(int(mix(np.array([x], np.uint64))[0])) == x


@pytest.fixture(scope="module", params=["known", "searched"])
def pair(request):
    found = PAIR if request.param == "known" else ("internationalize", twin("internationalize"))
    hashes = of(" ".join(found)).hashes()
    assert found[0] != found[1] and hashes[0] == hashes[1]
    return found


def test_numbers(pair):
    """Two words of one hash get numbers of their own, as long words and repeats do."""
    a, b = pair
    w = of(f"{a} {b} {a} x {'y' * 400} {'y' * 399}z {'y' * 400}", f"{b} x")
    numbers, first = w.numbers()
    spelled = [w.word(j) for j in range(len(w))]
    assert len(set(numbers.tolist())) == len(set(spelled)) == len(first)
    assert [spelled[first[n]] for n in numbers.tolist()] == spelled


def test_operators(spark, pair):
    a, b = pair
    nine = " ".join(f"w{i}" for i in range(9))
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{a} {nine}"), (2, f"{b} other words here")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs(f"{b} {nine}", f"{a} {nine}", f"{b} other words here"), items).collect()}
    assert got == {0: (0, 0), 1: (10, 1), 2: (4, 1)}
    near = neardup.near_duplicates(docs(f"{a} b c d", f"{b} b c d", f"{a} {nine}", f"{b} {nine}", f"{a.upper()} b c d"))
    assert {r.doc_id: r.component_id for r in near.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    line = " ".join(f"c{i}" for i in range(60))
    assert {r.doc_id: r.n_removed for r in repeats.without_repeats(docs(f"{line[:100]} {a} {line}", f"{line[:100]} {b} {line}")).collect()} == {0: 0, 1: 60}


def test_windows_apart(spark, monkeypatch):
    """Windows whose hashes agree, as a public polynomial allows: here every hash of windows does."""
    w = of("a b c d e f g h a b c d e", "b c d e f")
    assert len(np.unique(told_apart(w, 5)[0])) == len({tuple(w.word(j + i) for i in range(5)) for j in range(len(w) - 4)})
    real = words.windows
    weak = lambda hashes, k, salt=0: real(hashes, k, salt) if salt > 1 else np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for module in (words, neardup, repeats):
        monkeypatch.setattr(module, "windows", weak)
    hashes, salt = told_apart(w, 5)
    assert salt == 2 and len(np.unique(hashes)) == len({tuple(w.word(j + i) for i in range(5)) for j in range(len(w) - 4)})


def test_strong():
    w = of("a b c a b c a b d", "a b c")
    high, low = strong(w, 3, b"k" * 16)
    other = strong(w, 3, b"l" * 16)
    spelled = [tuple(w.word(j + i) for i in range(3)) for j in range(len(w) - 2)]
    for x in (high, low, *other):
        assert [[x[i] == x[j] for j in range(len(x))] for i in range(len(x))] == [[p == q for q in spelled] for p in spelled]
    assert not set(high.tolist()) & set(other[0].tolist())
    assert [len(x) for x in strong(of("a b"), 3, b"k" * 16)] == [0, 0] and len(windows(of("a b").hashes(), 3)) == 0
