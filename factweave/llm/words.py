"""Vectorised words, word hashes and rolling window hashes over Arrow string columns.

A batch's UTF-8 buffer is handled as one numpy byte array. A word's hash takes its length and
its bytes, eight at a time, through a mixing bijection; words of over LONG_WORD bytes are digested
by BLAKE2. A window's hash is a polynomial in an odd base modulo 2**64 over its words' hashes, got
from prefix sums, then mixed. Nulls are empty texts.

Words of one hash may differ, as may windows: such hashes find candidates and no more. What
decides goes by the words' bytes: `Words.numbers` tells words apart within a batch, `shingles`
windows, `equal_words` words of two batches, and `strong` gives windows digests that hold across
batches, under a key that is drawn anew for each run.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators of the two word rules, as byte values; bytes of non-ASCII characters belong to words.
SPACES = (0x20, *range(0x09, 0x0E))
NON_ALNUM = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19

#: Bytes of the longest word that is hashed by blocks of eight.
LONG_WORD = 256

_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_FOLD = _fold()
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LENGTH_SALT = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the inverses of those modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << max(0, n - 1).bit_length())
        up, down = np.full(size, base), np.full(size, _inverse(base))
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > 1 << 23:  # only an unusually long text needs it
            del _powers[int(base)]
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def block(eights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """The i-th eight bytes of each word, zeros behind its end; eights are those that begin at each byte."""
    return eights[starts + 8 * i] & _MASKS[np.clip(sizes - 8 * i, 0, 8)]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as one number, read in place."""
    padded = np.zeros(len(data) + LONG_WORD + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + LONG_WORD, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and first eight bytes. With another salt, other words share a hash."""
    sizes = ends - starts
    at = eights(data) if at is None else at
    heads = block(at, starts, sizes, 0)
    out = mix(heads ^ (sizes.astype(np.uint64) * _LENGTH_SALT) ^ np.uint64(salt))
    left = np.flatnonzero(sizes > 8)
    i = 1
    while len(left):
        if i * 8 >= LONG_WORD:
            raw = data.tobytes()
            for j in left.tolist():
                out[j] = int.from_bytes(hashlib.blake2b(raw[starts[j] : ends[j]], digest_size=8, key=salt.to_bytes(8, "little") if salt else b"").digest(), "little")
            break
        out[left] = mix(out[left] ^ block(at, starts[left], sizes[left], i))
        i += 1
        left = left[sizes[left] > 8 * i]
    return out, heads


class Spelled:
    """Words as places in some bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "eights"}

    @functools.cached_property
    def eights(self) -> np.ndarray:
        return eights(self.data)

    def hashes(self, salt: int = 0) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, salt, self.eights)[0]

    def word(self, j: int) -> bytes:
        return self.data[self.starts[j] : self.ends[j]].tobytes()

    def same(self, mine: np.ndarray, other: Spelled, others: np.ndarray) -> np.ndarray:
        """Whether each of the words at `mine` has the same bytes as the other's of its place."""
        starts, theirs, sizes = self.starts[mine], other.starts[others], self.ends[mine] - self.starts[mine]
        same = sizes == other.ends[others] - theirs
        left, i = np.flatnonzero(same), 0
        while len(left):
            if i * 8 >= LONG_WORD:
                for j in left.tolist():
                    same[j] = self.word(mine[j]) == other.word(others[j])
                break
            like = block(self.eights, starts[left], sizes[left], i) == block(other.eights, theirs[left], sizes[left], i)
            same[left[~like]] = False
            i += 1
            left = left[like & (sizes[left] > 8 * i)]
        return same

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, one for words of the same bytes, and each number's first place."""
        salt, n = 0, len(self)
        while True:
            hashes = self.hashes(salt)
            order = np.argsort(hashes, kind="stable")
            same = hashes[order[1:]] == hashes[order[:-1]]
            if self.same(order[1:][same], self, order[:-1][same]).all():
                break
            salt += 1  # two words share a hash
        out, new = np.empty(n, np.int64), np.concatenate((np.ones(min(n, 1), bool), ~same))
        out[order] = np.cumsum(new) - 1
        return out, order[new]


def classes(separators: tuple[int, ...], lower: bool = False) -> np.ndarray:
    """A class for each byte value: 0 for separators, 1 for the rest."""
    table = np.ones(256, np.int8)
    table[list(separators)] = 0
    return table[_FOLD] if lower else table


class Words(Spelled):
    """The words of some texts: runs of bytes of one class over 0. text i's words are those from first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.offsets, self.lower = offsets, lower
        self.data = _FOLD[data] if lower else data
        kind = table[data]
        begin, end = kind > 0, kind > 0
        if len(data):
            same = kind[1:] == kind[:-1]
            begin[1:] &= ~same
            end[:-1] &= ~same
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            begin[cuts] |= kind[cuts] > 0
            end[cuts - 1] |= kind[cuts - 1] > 0
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.kinds = kind[self.starts]
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of each k consecutive words, at the place of the first; the caller drops those that span texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE if not salt else mix(np.array([salt], np.uint64))[0] | np.uint64(1), len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def whole(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole sequence of words, as windows() gives it for k = its length."""
    return windows(hashes, len(hashes))[0]


def told_apart(words: Words, k: int) -> tuple[np.ndarray, int]:
    """Hashes of the windows of k words that are equal for equal words alone, and their salt: 0 but where windows of these texts share a hash."""
    numbers, salt = words.numbers()[0], 0
    while True:
        hashes = windows(words.hashes(salt), k, salt)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        a, b = order[1:][same], order[:-1][same]
        if all(np.array_equal(numbers[a + j], numbers[b + j]) for j in range(k)):
            return hashes, salt
        salt += 1


def strong(words: Words, k: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits for each window of k words, under a secret key of 16 bytes.

    Each distinct word's BLAKE2 digest of 128 bits; a window's are sums of its words' with random factors. Whoever
    writes the texts doesn't know the key, so two different windows agree in 96 bits with probability below 2**-90.
    """
    numbers, first = words.numbers()
    raw = words.data.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=16, key=key).digest() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
    each = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)[numbers]
    factors = np.frombuffer(b"".join(hashlib.blake2b(j.to_bytes(4, "little"), digest_size=16, key=key, person=b"factors").digest() for j in range(k)), np.uint64).reshape(-1, 2)
    n = max(0, len(words) - k + 1)
    out = []
    for lane in range(2):
        total, column = np.zeros(n, np.uint64), np.ascontiguousarray(each[:, lane])
        for j in range(k):
            total += column[j : j + n] * factors[j, lane]
        out.append(mix(total))
    return out[0], out[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most `limit` text bytes (or one row), each with its bytes and offsets."""
    data, offsets = buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and an executor's JVM shares the machine with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
