"""Periodic run detection (11) by descending-LCP Kruskal.

A text's words are numbered and its suffixes sorted by prefix doubling. Classes of suffixes are
united by decreasing length of the common prefix (LCP) of neighbours in that order; each class
keeps its positions in order. When two classes are united at LCP l, positions that become adjacent
at a distance d <= l seed a run of period d, which ends where their common prefix does. The
smallest such position is the run's start: d is the smallest period, as a smaller one would have put a
position of the same class between the two.

The texts of a batch are sorted together, with classes that never span texts. Only suffixes that
share with another of their text as many words as a run has at least take part, so most words of
plain texts leave after the first rounds.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, two
from .words import SPACES, Words, classes, pieces

#: A run's length in words, and in periods, at least.
LENGTH, EXPONENT = 6, 4
_TABLE = classes(SPACES)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where in that order each one's group begins."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
    return order, np.repeat(first, np.diff(np.append(first, len(keys))))


def suffix_ranks(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, within each text, until all differ.

    words: a number for each word. text, ends: of each word, its text and the place behind that text's last word.
    A rank is the place of the first suffix with it, plus one; 0 stands for a text's end.
    """
    n = len(words)
    order, group = _places(text * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = group + 1
    ranks, k = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n + 2)[rank] > 1)
    while len(active):
        after = active + k
        inside = after < ends[active]
        second = np.where(inside, rank[np.where(inside, after, 0)], 0)
        old = rank[active]
        order, group = _places(old * (n + 1) + second)
        runs = np.flatnonzero(np.diff(old[order], prepend=-1))  # where each old rank's members begin
        begin = np.repeat(runs, np.diff(np.append(runs, len(order))))
        rank[active[order]] = old[order] + group - begin
        active = active[np.bincount(rank[active], minlength=n + 2)[rank[active]] > 1]
        k *= 2
        ranks.append(rank.astype(ranks[0].dtype))
    return ranks


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many first words two suffixes of one text share."""
    shared, end = np.zeros(len(a), np.int64), ends[a]
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a + shared < end) & (b + shared < end))
        x, y = a[inside] + shared[inside], b[inside] + shared[inside]
        like = inside[ranks[level][x] == ranks[level][y]]
        shared[like] += 1 << level
    return shared


def seeds(prefixes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(position, distance, LCP) of the pairs that become adjacent, at no more than the LCP, while classes are united.

    prefixes: the LCP of each pair (a, b) of neighbours.
    """
    order = np.argsort(-prefixes, kind="stable")
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    positions, distances, lengths = [], [], []

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for lcp, x, y in zip(prefixes[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(x), find(y)
        large, small = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        root[y] = x
        last = len(small) - 1
        for i, p in enumerate(small):
            j = bisect_left(large, p)
            if j and p - large[j - 1] <= lcp and (not i or small[i - 1] < large[j - 1]):
                positions.append(large[j - 1])
                distances.append(p - large[j - 1])
                lengths.append(lcp)
            if j < len(large) and large[j] - p <= lcp and (i == last or small[i + 1] > large[j]):
                positions.append(p)
                distances.append(large[j] - p)
                lengths.append(lcp)
        if len(small) * 64 < len(large) or last == 0:
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()  # two sorted runs
        members[x] = large
    return positions, distances, lengths


def find_runs(words: np.ndarray, first: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """The runs (start, length, period) of some texts' words as rows, by start, then period; starts are places in `words`.

    words: numbers; text i's are those from first[i] to first[i + 1]. exponent: 2 or more.
    """
    if exponent < 2:
        raise ValueError("runs of fewer than two periods are not looked for")
    none = np.zeros((0, 3), np.int64)
    if not len(words):
        return none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = first[1:][text]
    ranks = suffix_ranks(words, text, ends)
    # The start of a run and the place a period behind it share this many words at least.
    least = min(max(length, exponent * q) - q for q in range(1, length + 2))
    level = max(0, min(least.bit_length() - 1, len(ranks) - 1))
    known = ranks[level]
    kept = np.flatnonzero(np.bincount(known, minlength=len(words) + 2)[known] > 1)
    if not len(kept):
        return none
    kept = kept[np.argsort(ranks[-1][kept], kind="stable")]
    a, b = kept[:-1], kept[1:]
    like = known[a] == known[b]
    a, b = a[like], b[like]
    prefixes = common_prefixes(ranks, a, b, ends)
    del ranks
    enough = prefixes >= least
    start, period, shared = (np.array(x, np.int64) for x in seeds(prefixes[enough], a[enough], b[enough]))
    if not len(start):
        return none
    end = start + period + shared
    order = np.lexsort((start, end, period))
    start, period, end = start[order], period[order], end[order]
    new = np.flatnonzero((np.diff(period, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0))
    start, period, size = start[new], period[new], (end - start)[new]
    good = size >= np.maximum(length, exponent * period)
    runs = np.stack((start[good], size[good], period[good]), axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs(length: int, exponent: int):
    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in pieces(batch):
                words = Words(data, offsets, _TABLE, lower=False)
                runs = find_runs(words.numbers()[0], words.first, length, exponent)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                dropped = np.cumsum(edge[:-1]) > 0
                of = np.searchsorted(words.first, runs[:, 0], "right") - 1
                runs[:, 0] -= words.first[of]
                bounds = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
                raw, texts = data.tobytes(), []
                for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    found = raw[a:b].split()  # bytes.split() parts at the same six characters
                    if bounds[t] < bounds[t + 1]:
                        at = int(words.first[t])
                        found = [found[i] for i in np.flatnonzero(~dropped[at : at + len(found)]).tolist()]
                    texts.append(b" ".join(found).decode())
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts(), pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return build


def periodic_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs.

    runs: array of (start, length, period) of the text's runs of at least `length` words and `exponent` periods, by
    start, then period. collapsed: the words, joined by one space, but for those that a run has after its first
    period. A null or blank text has no words; rows stay apart whatever their ids; an empty table gives none.
    Takes some 150 bytes of memory a word of the longest text (or of half a megabyte of texts).
    """
    return two(docs, id_col, text_col).mapInArrow(_runs(length, exponent), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: where crc32(doc_id) % 10 is 0, words from a on repeat those p from a. Other rows, and those without an id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.concat(F.slice("words", F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.col("words")[(a + i % p).cast("int")]))
    chosen = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("words"))
    return chosen.select("doc_id", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The run with greatest length / period; of equal ones the first."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.element_at(runs, 1), lambda best, x: F.when(better(x, best), x).otherwise(best))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(two(read(spark, sf_dir, "documents"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, _best(F.col("runs"))).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
