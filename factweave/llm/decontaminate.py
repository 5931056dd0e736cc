"""Benchmark decontamination (7): a generalised suffix automaton of the normalised test items.

Training tokens are streamed through the automaton, which gives at each token the length of the
longest run ending there that also stands in some item. A run of WINDOW words (or a whole shorter
item) is a hit; the words it covers are marked, and the items that hold it are looked up.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, small_batches, two, unused
from .words import NON_ALNUM, Spelled, Words, buffers, classes, pieces

WINDOW = 10
#: Words of the items in one automaton, whose arrays then take some 100 MB (the driver takes four times that while it makes them); more are taken in blocks, each a pass over the documents.
BLOCK_WORDS = 2_000_000
#: Bytes of items that the driver takes at once; more come as a stream, in order.
DRIVER_BYTES = 32 << 20
#: The stage drops a document of which a larger share of words is hit.
MAX_COVERAGE = 0.8
_TABLE = classes(NON_ALNUM, lower=True)


class Builder:
    """Makes the suffix automaton over word numbers, which accepts the runs of words that stand in one item.

    Most states have one edge, kept in two arrays; the others have a table.
    """

    def __init__(self) -> None:
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def get(self, at: int, word: int) -> int:
        return self.to[at] if self.word[at] == word else self.more[at].get(word, -1) if at in self.more else -1

    def put(self, at: int, word: int, to: int) -> None:
        if self.word[at] in (-1, word):
            self.word[at], self.to[at] = word, to
        else:
            self.more.setdefault(at, {})[word] = to

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        if (to := self.get(last, word)) >= 0:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new, at = self._state(self.length[last] + 1, 0), last
        while at >= 0 and self.get(at, word) < 0:
            self.put(at, word, new)
            at = self.link[at]
        if at >= 0:
            to = self.get(at, word)
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _state(self, length: int, link: int) -> int:
        for column, x in ((self.word, -1), (self.to, -1), (self.length, length), (self.link, link)):
            column.append(x)
        return len(self.word) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[to])
        self.word[copy], self.to[copy] = self.word[to], self.to[to]
        if to in self.more:
            self.more[copy] = dict(self.more[to])
        self.link[to] = copy
        while at >= 0 and self.get(at, word) == to:
            self.put(at, word, copy)
            at = self.link[at]
        return copy

    def edges(self) -> tuple[array, array, array]:
        """Where each state's edges start, their words, rising within a state, and where they lead."""
        sizes = np.array(self.word) >= 0
        sizes = sizes.astype(np.int64)
        for at, table in self.more.items():
            sizes[at] += len(table)
        start = np.concatenate(([0], np.cumsum(sizes)))
        word, to = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.int32)
        one = np.flatnonzero(sizes)
        word[start[one]], to[start[one]] = np.array(self.word)[one], np.array(self.to)[one]
        for at, table in self.more.items():
            every = sorted([(self.word[at], self.to[at]), *table.items()])
            word[start[at] : start[at + 1]], to[start[at] : start[at + 1]] = zip(*every, strict=True)
        return array("q", start.tobytes()), array("i", word.tobytes()), array("i", to.tobytes())


class Automaton:
    """The automaton as arrays, and the items of each window: a window of k words is the state whose runs of k words are all one."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        made = Builder()
        for _, words in items:
            made.add(words)
        self.window, self.link, self.length = window, made.link, made.length
        self.start, self.word, self.to = made.edges()
        del made
        lengths = {min(window, len(words)) for _, words in items if words}
        self.short, self.least = sorted(lengths - {window}), min(lengths, default=window)
        told = {k: (array("q"), array("q")) for k in lengths}  # by length: states, items
        for item, words in items:
            if k := min(window, len(words)):
                for state, matched in self.steps(words):
                    if matched >= k:
                        told[k][0].append(self.at_length(state, k))
                        told[k][1].append(item)
        self.items = {}
        for k, (states, names) in told.items():
            pairs = np.unique(np.stack((np.array(states), np.array(names)), axis=1), axis=0)
            self.items[k] = (array("q", pairs[:, 0].tobytes()), array("q", pairs[:, 1].tobytes()))

    def steps(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word, the state and how many last words it has; what goes beyond a window is let go."""
        start, edge, to, link, length, k = self.start, self.word, self.to, self.link, self.length, self.window
        state = matched = 0
        for word in words:
            while True:
                a, b = start[state], start[state + 1]
                place = bisect_left(edge, word, a, b)
                if place < b and edge[place] == word:
                    state, matched = to[place], matched + 1
                    while length[link[state]] >= k:
                        state = link[state]
                    matched = min(matched, length[state])
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            yield state, matched

    def at_length(self, state: int, k: int) -> int:
        """The state of the last k words of a state that has more."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def of_window(self, state: int, k: int) -> list[int]:
        states, names = self.items[k]
        state = self.at_length(state, k)
        a = bisect_left(states, state)
        b = a
        while b < len(states) and states[b] == state:
            b += 1
        return names[a:b].tolist()

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end; they may touch or overlap) and the items that they hold."""
        spans, found, k = [], set(), self.window
        for p, (state, matched) in enumerate(self.steps(words)):
            if matched >= k and (items := self.of_window(state, k)):
                spans.append((p + 1 - k, p + 1))
                found.update(items)
            for n in self.short:
                if matched < n:
                    break
                if items := self.of_window(state, n):
                    spans.append((p + 1 - n, p + 1))
                    found.update(items)
        return spans, found


class Vocabulary:
    """The items' words, by a hash that no two of them share. A text's word is known if it has the bytes of the one with its hash."""

    def __init__(self, words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        ends, self.salt = np.cumsum(sizes), 0
        spelled = Spelled(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
        while len(np.unique(hashes := spelled.hashes(self.salt))) < len(words):
            self.salt += 1
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.words = Spelled(spelled.data, spelled.starts[self.order], spelled.ends[self.order])

    def __len__(self) -> int:
        return len(self.hashes)


def _items(rows: list, window: int) -> tuple[Vocabulary, Automaton]:
    """The items' words, and the automaton over their places in the vocabulary."""
    text = pa.array([r.text for r in rows], pa.string())
    known: dict[bytes, int] = {}
    items: list[np.ndarray] = []
    for _, data, offsets in pieces(pa.RecordBatch.from_arrays([text], ["text"])):
        words = Words(data, offsets, _TABLE, lower=True)
        numbers, first = words.numbers()
        named = np.array([known.setdefault(words.word(j), len(known)) for j in first.tolist()], np.int64)
        items += np.split(named[numbers], words.first[1:-1])
    vocabulary = Vocabulary(list(known))
    place = np.empty(len(known), np.int64)
    place[vocabulary.order] = np.arange(len(known))
    return vocabulary, Automaton([(r.item_id, place[x].tolist()) for r, x in zip(rows, items, strict=True)], window)


class Scanner:
    """Finds hits in texts; words that no item has are passed over without a step of the automaton."""

    def __init__(self, known: Vocabulary, automaton: Automaton):
        self.known, self.automaton = known, automaton
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(known.hashes >> np.uint64(44)).astype(np.int64)] = True

    def scan(self, words: Words) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """(text number, spans in its words, items) of the texts with hits."""
        hashes = words.hashes(self.known.salt)
        maybe = np.flatnonzero(self.quick[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.known) or not len(maybe):
            return
        place = np.minimum(np.searchsorted(self.known.hashes, hashes[maybe]), len(self.known) - 1)
        real = self.known.hashes[place] == hashes[maybe]
        at, ids = maybe[real], place[real]
        real = words.same(at, self.known.words, ids)
        at, ids = at[real], ids[real]
        if not len(at):
            return
        text = np.searchsorted(words.first, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0)) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
        long = end - begin >= self.automaton.least
        current, spans, items = -1, [], set()
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            hit, held = self.automaton.stream(ids[a:b].tolist())
            if not hit:
                continue
            t = int(text[a])
            if t != current:
                if spans:
                    yield current, spans, items
                current, spans, items = t, [], set()
            shift = int(at[a]) - int(words.first[t])
            spans += [(x + shift, y + shift) for x, y in hit]
            items |= held
        if spans:
            yield current, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(spans: list[tuple[int, int]], items: set, n: int) -> tuple[int, int, int, str, bool]:
    hit = sum(b - a for a, b in merged(spans))
    named = ",".join(sorted(str(i) for i in items))
    return n, hit, len(items), hashlib.sha256(named.encode()).hexdigest(), hit > 0


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _blocks(items: DataFrame, words: int) -> Iterator[list]:
    """Items with an id, in order, as many as have that many words, or one: no more are on the driver at once but for a part of the table."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.orderBy("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    rows, held = [], 0
    for row in items.collect() if size <= DRIVER_BYTES else items.toLocalIterator():
        n = len(Words(*buffers(pa.array([row.text])), _TABLE, lower=True))
        if rows and held + n > words:
            yield rows
            rows, held = [], 0
        rows.append(row)
        held += n
    if rows:
        yield rows


def _automata(items: DataFrame, window: int, words: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each block's automaton, broadcast, and whether it's the only one. One that isn't goes when the next is asked for."""
    sc, blocks = items.sparkSession.sparkContext, _blocks(items, words)
    rows, only = next(blocks, None), True
    while rows is not None:
        after = next(blocks, None)
        only = only and after is None
        shared = sc.broadcast(_items(rows, window))  # some 40 bytes a word of the items, so BLOCK_WORDS bounds it
        yield shared, only
        if not only:
            shared.destroy()
        rows = after


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs.

    A null or empty text (or item) has no words. Items without an id are left out; items that
    repeat one id count once. Rows stay apart whatever their ids. No items: nothing is hit.
    block: words of the items in one automaton.
    """
    source = two(docs, id_col, text_col)
    automata, found = _automata(items, window, block), None
    shared, only = next(automata, (None, True))
    if only:
        return source.mapInArrow(_scan_digests(shared), f"doc_id long, {DIGEST}")
    # Blocks: a pass each, told apart by the row's number; their spans meet again by that number.
    numbered = saved(source.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    while shared is not None:
        one = saved(numbered.mapInArrow(_scan_spans(shared), "row long, doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<long>"), "decontaminate-spans")
        found = one if found is None else found.unionByName(one)
        shared, _ = next(automata, (None, False))
    joined = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches):
        for batch in batches:
            out = [_digest([(s["a"], s["b"]) for s in r["spans"]], set(r["items"]), r["n_words"]) for r in batch.select(["spans", "items", "n_words"]).to_pylist()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], ["doc_id", *DIGEST.replace(",", "").split(" ")[::2]])

    return joined.mapInArrow(finish, f"doc_id long, {DIGEST}")


def _scan_digests(shared: Broadcast | None):
    nothing = _digest([], set(), 0)

    def build(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(*(shared.value if shared else (Vocabulary([]), None)))
        for batch in batches:
            for part, data, offsets in pieces(batch):
                words = Words(data, offsets, _TABLE, lower=True)
                counts = words.counts()
                out = [[n, *nothing[1:]] for n in counts.tolist()]
                for t, spans, items in scanner.scan(words):
                    out[t] = list(_digest(spans, items, int(counts[t])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True))], ["doc_id", *DIGEST.replace(",", "").split(" ")[::2]])

    return build


def _scan_spans(shared):
    def build(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(*shared.value)
        for batch in batches:
            for part, data, offsets in pieces(batch):
                words = Words(data, offsets, _TABLE, lower=True)
                rows = [{"row": r, "doc_id": i, "n_words": n, "spans": [], "items": []} for r, i, n in zip(part.column("row").to_pylist(), part.column(0).to_pylist(), words.counts().tolist(), strict=True)]
                for t, spans, items in scanner.scan(words):
                    rows[t] |= {"spans": [{"a": a, "b": b} for a, b in merged(spans)], "items": sorted(items)}
                pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pair)), ("items", pa.list_(pa.int64()))]))

    return build


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, coverage: float = MAX_COVERAGE, block: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit words; a document goes if more than `coverage` of its words are hit.

    Each removed span takes the separators behind it along. Other columns stay, and n_chars, if
    there is one, follows the text. Texts without hits, nulls among them, stay as they are.
    Blocks of items are all looked for in the texts as given; their spans are then cut at once.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    automata, found = _automata(items, window, block), None
    shared, only = next(automata, (None, True))
    if only:
        return docs.mapInArrow(_cut_scanned(shared, names.index(text_col), coverage), docs.schema) if shared else docs
    # Blocks: a pass each over the same texts, whose spans meet again by the row's number.
    row, spans = unused("row", names), unused("spans", names)
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    source = numbered.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(row).alias("row"))
    while shared is not None:
        one = saved(source.mapInArrow(_scan_spans(shared), "row long, doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<long>").where("size(spans) > 0").select("row", "spans"), "decontaminate-spans")
        found = one if found is None else found.unionByName(one)
        shared, _ = next(automata, (None, False))
    found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias(spans)).withColumnRenamed("row", row)
    joined = numbered.join(found, row, "left").select(*names, spans)
    return joined.mapInArrow(_cut_joined(names.index(text_col), coverage), docs.schema)


def _cut(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, words: Words, hits: Iterator[tuple[int, list[tuple[int, int]]]], at: int, coverage: float) -> pa.RecordBatch:
    """part without the hit words, and without the rows of which too large a share is hit."""
    counts, new, keep = words.counts(), {}, np.ones(part.num_rows, bool)
    for t, spans in hits:
        spans = merged(spans)
        keep[t] = sum(b - a for a, b in spans) <= coverage * counts[t]
        kept, last = [], int(offsets[t])
        for a, b in spans:
            a, b = a + int(words.first[t]), b + int(words.first[t])
            kept.append(data[last : words.starts[a]].tobytes())
            last = int(words.starts[b]) if b < words.first[t + 1] else int(offsets[t + 1])
        kept.append(data[last : offsets[t + 1]].tobytes())
        new[t] = b"".join(kept).decode("utf-8", "replace")
    return replaced(part, at, new, keep)


def _cut_scanned(shared: Broadcast, at: int, coverage: float):
    def build(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(*shared.value)
        for batch in batches:
            for part, data, offsets in pieces(batch, batch.schema.names[at]):
                words = Words(data, offsets, _TABLE, lower=True)
                yield _cut(part, data, offsets, words, ((t, spans) for t, spans, _ in scanner.scan(words)), at, coverage)

    return build


def _cut_joined(at: int, coverage: float):
    """The last column holds each row's spans, or null."""

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in pieces(batch, batch.schema.names[at]):
                hits = [(t, [(x["a"], x["b"]) for x in spans]) for t, spans in enumerate(part.column(part.num_columns - 1).to_pylist()) if spans]
                bare = pa.RecordBatch.from_arrays(part.columns[:-1], schema=pa.schema(list(part.schema)[:-1]))
                yield _cut(bare, data, offsets, Words(data, offsets, _TABLE, lower=True), iter(hits), at, coverage)

    return build


def replaced(part: pa.RecordBatch, at: int, new: dict[int, str], keep: np.ndarray | None = None) -> pa.RecordBatch:
    """part with new texts in column `at`, n_chars to match, and only the rows to keep."""
    if new:
        columns = list(part.columns)
        texts = columns[at].to_pylist()
        for t, x in new.items():
            texts[t] = x
        columns[at] = pa.array(texts, columns[at].type)
        if "n_chars" in part.schema.names:
            j = part.schema.names.index("n_chars")
            sizes = columns[j].to_pylist()
            for t, x in new.items():
                sizes[t] = len(x)
            columns[j] = pa.array(sizes, columns[j].type)
        part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
    return part if keep is None or keep.all() else part.filter(pa.array(keep))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stage: benchmark words go, and documents that are little else. Nulls and rows without hits stay as they are, each row for itself; an empty table stays empty."""
    return cleaned(docs, read(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k),
hits AS (SELECT p.doc_id, p.s, p.k, win.item_id FROM (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM pos) p JOIN win ON win.k = p.k AND win.g = p.g),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS i FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
