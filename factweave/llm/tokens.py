"""Ids of whole texts, as the tokenizers library gives them, with each distinct word encoded once.

A batch is cut into pre-tokens over its bytes with numpy, by the rule of the vocabulary file, and
only words that a bounded table lacks go to the library. A word of up to EXACT bytes is told by
its length, its first eight bytes and its hash, which leave no two words equal (a hash is a
bijection of the second eight bytes then); longer ones, and any that clash, are told by their
bytes. Texts with characters outside ASCII and the Latin letters, or with the name of a
special token, go to the library whole, so every text gets the library's ids.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

from .words import word_hashes

#: Distinct words kept by a worker, but for those of the last chunk; then its table starts anew.
TABLE_WORDS, SLOT_BITS = 600_000, 21
#: Bytes up to which length, first eight bytes and hash tell a word.
EXACT = 16
#: Words in one text for the library.
GROUP = 200
LETTER, DIGIT, OTHER, SPACE, ODD = 1, 2, 3, 0, 4


def _ascii_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.int8)
    table[[*range(65, 91), *range(97, 123)]] = LETTER
    table[range(48, 58)] = DIGIT
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[range(0x1C, 0x20)] = ODD
    table[0x80:] = ODD
    table[0x80:0xC0] = LETTER  # second bytes, once the first is one of a Latin letter
    return table


_CLASSES = _ascii_classes()


def id_crc_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


class Encoder:
    """encode() gives the ids of some texts and how many each has. kind: "bytes" (spaces stay) or "words" (lower case, none)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.ends_words = bool(spec["model"].get("end_of_word_suffix"))
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        lead = range(0xC3, 0xC4) if self.ends_words else range(0xC3, 0xCA)
        self.classes = _CLASSES.copy()
        self.classes[list(lead)] = LETTER
        vocab = spec["model"]["vocab"]
        size = max(vocab.values()) + 1
        if size > 1 << 16:
            raise ValueError(f"{path}: ids need more than 16 bits")
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.is_end = np.zeros(size + 1000, bool)
        self.width = np.zeros(size + 1000, np.int64)
        for token, i in vocab.items():
            self.is_end[i] = bool(suffix) and token.endswith(suffix)
            self.width[i] = len(token)  # a letter of the byte alphabet for each byte
        self.line_break = self.tokenizer.token_to_id("Ċ")
        self._clear()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        kind = self.classes[data]
        odd = self._odd(data, kind, offsets)
        raw = np.where(_in_texts(odd, offsets), np.uint8(0x20), data) if odd.any() else data  # those are encoded whole below
        if odd.any():
            kind = self.classes[raw]
        starts, ends, of = self._cut(raw, kind, offsets)
        if self.ends_words:
            raw = _lower(raw)
        back = self._look_up(raw, starts, ends)
        at, size, pool = self.at, self.size, self.ids
        counts = np.bincount(of, size[back], n).astype(np.int64) if len(of) else np.zeros(n, np.int64)
        if odd.any():  # their blanks, in the byte kind, have been cut too
            mine = ~odd[of]
            back, of = back[mine], of[mine]
            counts[odd] = 0
        lengths = size[back]
        place = np.repeat(at[back] - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(back) else at[back], lengths)
        ids = pool[place + np.arange(len(place))]
        return self._whole(data, offsets, odd, ids, counts) if odd.any() else (ids, counts)

    def _odd(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts for the library: with other characters than the classes know, or a special token's name."""
        bad = kind == ODD
        if len(data) > 1:
            lead = data[:-1] == 0xC3
            bad[:-1] |= lead & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of multiplication and division
        places = np.flatnonzero(bad).tolist()
        raw = None
        for name in self.special:
            if (data == name[0]).any():
                raw = raw or data.tobytes()
                at = raw.find(name)
                while at >= 0:
                    places.append(at)
                    at = raw.find(name, at + 1)
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, places, "right") - 1] = True
        return odd

    def _cut(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pre-tokens start and end, and of which text each is."""
        size = len(data)
        if not size:
            return (np.zeros(0, np.int64),) * 3
        cuts = offsets[(offsets > 0) & (offsets < size)]
        begin = np.empty(size, bool)
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin[cuts] = True
        space, letter = kind == SPACE, kind == LETTER
        fresh = np.zeros(size, bool)  # a text's first byte
        fresh[cuts] = True
        fresh[0] = True
        if self.ends_words:
            begin |= kind == DIGIT
        else:
            # A run of blanks before a word: all but the last are one token, and a last blank goes to the word.
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:])
            begin[last + 1] = data[last] != 0x20
            begin[last] = True
        # 's 't 'm 'd 're 've 'll where the apostrophe is a token of its own.
        mark = np.flatnonzero((data == 0x27) & begin)
        mark = mark[mark + 1 < size]
        mark = mark[letter[mark + 1] & ~fresh[mark + 1]]
        if len(mark):
            low = data | 0x20 if self.ends_words else data
            one, two = low[mark + 1], low[np.minimum(mark + 2, size - 1)]
            more = (mark + 2 < size) & letter[np.minimum(mark + 2, size - 1)] & ~fresh[np.minimum(mark + 2, size - 1)]
            extra = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
            extra += 2 * (more & ((one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)))
            mark, extra = mark[extra > 0], extra[extra > 0]
            begin[mark + 1] = False
            after = mark + 1 + extra
            begin[after[after < size]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], size)
        if self.ends_words:
            word = ~space[starts]
            starts, ends = starts[word], ends[word]
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def _look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's place in the table; new words are encoded and put there.

        A slot of the hash's high bits names a word; words whose slot is taken are found in a
        sorted list. A full table is emptied first, so its size is bounded.
        """
        if len(self.hashes) > TABLE_WORDS or len(self.ids) > 8 * TABLE_WORDS:
            self._clear()
        sizes = ends - starts
        hashes, head = word_hashes(raw, starts, ends)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = self.slots[slot].astype(np.int64)
        right = (self.hashes[found] == hashes) & (self.heads[found] == head) & (self.sizes[found] == sizes)
        rest = np.flatnonzero(~right | (sizes > EXACT))
        if not len(rest):
            return found
        by_bytes, rest = rest[sizes[rest] > EXACT], rest[sizes[rest] <= EXACT]
        if len(rest):
            distinct, first, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.spilled, distinct), len(self.spilled) - 1)
            known = self.spilled[place] == distinct
            index = np.where(known, self.spilled_at[place], 0)
            new = np.flatnonzero(~known)
            if len(new):
                first = rest[first[new]]
                index[new] = self._add(raw, starts[first], ends[first], distinct[new], head[first])
                free = self.slots[slot[first]] == 0
                self.slots[slot[first[free]]] = index[new[free]]
                lost = new[self.slots[slot[first]] != index[new]]
                where = np.searchsorted(self.spilled, distinct[lost])
                self.spilled, self.spilled_at = np.insert(self.spilled, where, distinct[lost]), np.insert(self.spilled_at, where, index[lost])
            found[rest] = index[back]
            clash = (self.heads[found[rest]] != head[rest]) | (self.sizes[found[rest]] != sizes[rest])
            by_bytes = np.concatenate((by_bytes, rest[clash]))
        if len(by_bytes):
            buffer = raw.tobytes()
            words = [buffer[a:b] for a, b in zip(starts[by_bytes].tolist(), ends[by_bytes].tolist(), strict=True)]
            new = {w: i for w, i in zip(words, by_bytes.tolist(), strict=True) if w not in self.by_bytes}
            if new:
                at = np.array(list(new.values()))
                self.by_bytes.update(zip(new, self._add(raw, starts[at], ends[at], np.zeros(len(at), np.uint64), head[at]).tolist(), strict=True))
            found[by_bytes] = [self.by_bytes[w] for w in words]
        return found

    def _add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Places of new words in the table, each with its ids."""
        index, buffer = len(self.hashes) + np.arange(len(starts)), raw.tobytes()
        ids, at, lengths = self._encode_words([buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        self.at, self.size = np.append(self.at, len(self.ids) + at), np.append(self.size, lengths)
        self.hashes, self.heads, self.sizes = np.append(self.hashes, hashes), np.append(self.heads, heads), np.append(self.sizes, ends - starts)
        self.ids = np.append(self.ids, ids)
        return index

    def _clear(self) -> None:
        """An empty table; its first place is of no word."""
        self.hashes, self.heads, self.sizes = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.full(1, -1, np.int64)
        self.at, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.spilled, self.spilled_at = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.by_bytes: dict[bytes, int] = {}

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids of single pre-tokens, many in one text where they stay apart: ids, and each word's place and length."""
        at, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if self.ends_words:
            groups = [(np.arange(len(words)), b" ")]
        else:
            # With a blank before each, words stay apart; those without one are parted by a line break, of one token.
            bare = np.array([not w.isspace() for w in words])
            blank = np.array([w[0] == 0x20 for w in words]) & bare
            groups = [(np.flatnonzero(blank), b""), (np.flatnonzero(bare & ~blank), b"\n"), *((np.array([i]), b"") for i in np.flatnonzero(~bare))]
        ids, done = [], 0
        for where, gap in groups:
            for i in range(0, len(where), GROUP):
                group = where[i : i + GROUP]
                mine = [words[j] for j in group.tolist()]
                found = np.array(self.tokenizer.encode(gap.join(mine).decode(), add_special_tokens=False).ids, np.uint16)
                if self.ends_words:
                    ends = np.flatnonzero(self.is_end[found]) + 1
                else:
                    if gap:
                        found = found[found != self.line_break]
                    ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum([len(w) for w in mine])) + 1
                lengths[group] = np.diff(ends, prepend=0)
                at[group] = done + ends - lengths[group]
                done += len(found)
                ids.append(found)
        return np.concatenate(ids), at, lengths

    def _whole(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd).tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts


def _in_texts(odd: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.repeat(odd, np.diff(offsets))


def _lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[capital] += 32
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker and file, so that tasks share its table."""
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_ids(ids: np.ndarray, counts: np.ndarray, end: int | None = None) -> list[np.ndarray]:
    parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
    return parts if end is None else [np.append(p, np.uint16(end)) for p in parts]


def binary_ids(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
