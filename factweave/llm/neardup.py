"""MinHash near-dedup (8): one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Equal word sequences are one class from the start, by a digest of 128 bits. Each class has one signature of BINS bins; an empty bin
borrows from the first non-empty bin in its own fixed random order. In each bucket of a band all
classes are tied to the smallest only, so candidate edges are at most the bucket rows. The stars'
connected families hold every pair that shares a bucket; within a family links are confirmed on
the full sets, and only a spanning forest of the links leaves the task.

Pairs inside one component need no look: a family is compared from its most typical text on, and
then only texts that aren't linked with that one, however far, are compared with others (by
prefix filters on the rarest shingles and their places). Links go by the shingles themselves: their
hashes only find candidates, and within a task are checked to tell its shingles apart. A family too large for one task is dealt into blocks; all
blocks also get a few common centres. What then lies outside a family's largest component, often
nothing, is compared with all its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, read, saved, small_enough, two, unused
from .words import SPACES, Words, buffers, classes, mix, pieces, told_apart, whole, windows

SHINGLE = 5
#: Links need 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
#: A pair shares no bucket with probability (1 - similarity**6)**42: 3e-6 at 0.8, 3e-9 at 0.85.
BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
#: Shingles of the documents in one block of a family; smaller families are one task.
BLOCK_SHINGLES = 2_000_000
#: Texts of a large family, one from each of its first blocks, that all of its blocks are compared with.
CENTRES = 8
#: Small tables (at most six numbers a row, so 64 MB) are broadcast up to this count of rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Nodes with more edges than this, and than a 50,000th of all edges (so they are few), are salted in a join.
HOT_EDGES, MOST_HOT = 2_000, 50_000
#: Candidates that are compared with a text at first; then twice as many each time.
FIRST_LOOK = 64
_TABLE = classes(SPACES, lower=True)


def _orders() -> np.ndarray:
    """For each bin, all bins in the random order in which it borrows."""
    rng = np.random.Generator(np.random.PCG64(8))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_ORDERS = _orders()
_EDGES = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)


def _by_text(words: Words, rolled: np.ndarray) -> list[np.ndarray]:
    """Each text's set: the sorted distinct values that `rolled` has for its shingles."""
    out, hashes = [], None
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        else:
            hashes = words.hashes() if hashes is None and b > a else hashes
            out.append(np.array([whole(hashes[a:b])] if b > a else [], np.uint64))
    return out


def exact_sets(words: Words) -> list[np.ndarray]:
    """Each text's set as numbers, equal for equal shingles of these texts alone; a text of fewer words is one shingle."""
    rolled, _ = told_apart(words, SHINGLE)
    distinct, numbers = np.unique(rolled, return_inverse=True)
    numbers, short, out = numbers.astype(np.uint64), {}, []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(numbers[a : b - SHINGLE + 1]))
        else:
            key = tuple(words.word(j) for j in range(a, b))
            out.append(np.array([len(distinct) + short.setdefault(key, len(short))] if key else [], np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a non-empty sorted set, empty bins filled."""
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.append(at[1:], len(shingles))
    values = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDERS[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return values


_BAND_SALT = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0x5EED))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    keys = _BAND_SALT.copy()
    for column in signature(shingles).reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]):
    """Size of the set, digest of the words and band keys of each text."""
    for batch in batches:
        for part, data, offsets in pieces(batch):
            words = Words(data, offsets, _TABLE, lower=True)
            rolled, salt = told_apart(words, SHINGLE)
            sets = _by_text(words, rolled)
            sizes = [len(s) for s in sets]
            if salt:  # candidates go by the hashes that all tasks have
                sets = _by_text(words, windows(words.hashes(), SHINGLE))
            raw = words.data.tobytes()
            same = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() if n else None for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), sizes, strict=True)]
            keys = pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), keys], ["doc_id", "n_shingles", "same", "bands"])


def _with_least(edges: DataFrame, n_edges: int, own: bool) -> DataFrame:
    """edges (a, b) and m, the least b of a (or a itself, with own). A node of very many edges is salted, so no task gets all of them."""
    hot = max(HOT_EDGES, 2 * n_edges // MOST_HOT)
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    salted = F.broadcast(least.where("parts > 1").select("a", "parts"))  # at most MOST_HOT rows, as all parts together are that many
    rows = edges.join(salted, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).cast("int").alias("salt"))
    copies = least.select("a", F.least("a", "m").alias("m") if own else "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return rows.join(copies, ["a", "salt"]).select("a", "b", "m")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn, each written to the shared folder, until a round
    changes nothing; nothing of the graph is on the driver but a count.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, n, own=True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n, own=False)
        step = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        last, now = now, saved(step, "edges")
        deleted(now.sparkSession, last.inputFiles()[0].rsplit("/", 1)[0])
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, n = tuple(state), state[0]
    nodes = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Components:
    """A component's number for each of n items; the smaller of two joined ones takes the other's number."""

    def __init__(self, labels: np.ndarray):
        order = np.argsort(labels, kind="stable")
        edge = np.flatnonzero(np.diff(labels[order], prepend=labels[order[0]] - 1))
        self.of = np.empty(len(labels), np.int64)
        self.of[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(labels))))
        self.members = [part.tolist() for part in np.split(order, edge[1:])]

    def join(self, i: int, j: int) -> bool:
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def linked(sets: list[np.ndarray], similarity: int, labels: np.ndarray | None = None, pivots: int | None = None) -> list[tuple[int, int]]:
    """Links among sets that join all that links join, as pairs of places: a spanning forest of the links.

    labels: sets of one label are one component already. With pivots, only pairs with one of
    the first so many sets count. Shingles are ranked, rarest first. Of two sets at the threshold the smaller
    has a common shingle among its first `index`, the other among its first `probe`; and behind the
    first common one enough must be left of both. Only pairs that pass both are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingles, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(shingles), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(shingles))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    typical = int(np.argmax(np.add.reduceat(often[at], ends[:-1]) / sizes))
    at = rank[at]
    at = at[np.lexsort((at, owner))]
    place = np.arange(len(at)) - ends[:-1][owner]
    probe = sizes + 1 - (similarity * sizes + 99) // 100
    index = sizes + 1 - (2 * similarity * sizes + 99 + similarity) // (100 + similarity)

    def listed(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each shingle, where its sets stand that have it in their prefix; the sets; its places in them."""
        chosen = np.flatnonzero(place < prefix[owner])
        chosen = chosen[np.argsort(at[chosen], kind="stable")]
        return np.searchsorted(at[chosen], np.arange(len(shingles) + 1)), owner[chosen], place[chosen]

    smaller, larger = listed(index), listed(probe)
    groups, forest = Components(np.arange(len(sets)) if labels is None else labels), []
    mark = np.zeros(len(shingles), bool)

    def spread(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))

    def candidates(i: int) -> np.ndarray:
        found, mine, theirs = [], [], []
        for (start, sets_of, places), prefix, larger_ones in ((smaller, probe[i], False), (larger, index[i], True)):
            own = at[ends[i] : ends[i] + prefix]
            count = start[own + 1] - start[own]
            posted = spread(start[own], count)
            other = sets_of[posted]
            good = (sizes[other] > sizes[i]) == larger_ones
            found.append(other[good])
            mine.append(np.repeat(np.arange(prefix), count)[good])
            theirs.append(places[posted][good])
        found, first = np.unique(np.concatenate(found), return_index=True)
        mine, theirs = np.concatenate(mine)[first], np.concatenate(theirs)[first]
        both = sizes[found] + sizes[i]
        left = np.minimum(sizes[i] - mine, sizes[found] - theirs)
        good = ((100 + similarity) * left >= similarity * both) & (100 * np.minimum(sizes[found], sizes[i]) >= similarity * np.maximum(sizes[found], sizes[i]))
        found = found[good]
        return found[groups.of[found] != groups.of[i]]

    for i in range(pivots) if pivots is not None else [typical, *range(len(sets))]:
        if pivots is None and i != typical and groups.of[i] == groups.of[typical]:
            continue
        found = candidates(i)
        if not len(found):
            continue
        mark[at[ends[i] : ends[i + 1]]] = True
        look = FIRST_LOOK
        while len(found):
            some, found = found[:look], found[look:]
            both = np.add.reduceat(mark[at[spread(ends[some], sizes[some])]], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            forest += [(i, j) for j in some[100 * both >= similarity * (sizes[i] + sizes[some] - both)].tolist() if groups.join(i, j)]
            found, look = found[groups.of[found] != groups.of[i]], 2 * look
        mark[at[ends[i] : ends[i + 1]]] = False
    return forest


def _confirm(similarity: int):
    def build(table: pa.Table) -> pa.Table:
        """One block of a family, or its rest (side 0) and a block: links as edges between classes. Texts of one label are one component."""
        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        batch = table.combine_chunks().to_batches()[0]
        sets = exact_sets(Words(*buffers(batch.column("text")), _TABLE, lower=True))
        ids, sides = batch.column("doc_id").to_numpy(), batch.column("side").to_numpy()
        forest = linked(sets, similarity, batch.column("label").to_numpy(), int((sides == 0).sum()) if sides[0] == 0 else None)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in forest], pa.int64()), "b": pa.array([int(ids[j]) for _, j in forest], pa.int64())})

    return build


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def _links(source: DataFrame, dealt: DataFrame, similarity: int) -> DataFrame:
    """Links inside the groups (family, x, y) of dealt (rep, family, x, y, side, label)."""
    # A repeated id may have several texts; the class's own is any whose set is the class's.
    texts = source.join(_small(dealt), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "family", "x", "y", "side", "label")
    return saved(texts.groupBy("family", "x", "y").applyInArrow(_confirm(similarity), "a long, b long"), "links")


def confirmed(source: DataFrame, family: DataFrame, similarity: int) -> DataFrame:
    """(a, b) that join what links join inside each family of (rep, family, n_shingles)."""
    blocks = lambda: F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int")
    large = family.groupBy("family").agg(blocks().alias("blocks")).where("blocks > 1")
    some = large.limit(1).count() > 0
    if not some:
        return _links(source, family.select("rep", "family", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("side"), F.col("rep").alias("label")), similarity)
    large = saved(large, "large-families")
    sized = family.join(_small(large), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = sized.select("rep", "family", F.col("own").alias("x"))
    centres = sized.where((F.col("blocks") > 1) & (F.col("own") < CENTRES)).groupBy("family", "own", "blocks").agg(F.min_by("rep", F.xxhash64("rep")).alias("rep"))
    centres = centres.select("rep", "family", "own", each("blocks").alias("x")).where("x <> own").select("rep", "family", "x")
    dealt = members.unionByName(centres).select("*", F.lit(0).alias("y"), F.lit(1).alias("side"), F.col("rep").alias("label"))
    links = _links(source, dealt, similarity)

    # What lies outside the largest component of a large family meets all its blocks.
    labelled = sized.where("blocks > 1").join(connected(links), F.col("rep") == F.col("node"), "left").select("rep", "family", "n_shingles", "own", "blocks", F.coalesce("root", "rep").alias("label"))
    labelled = saved(labelled, "labelled")
    main = labelled.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    rest = labelled.join(_small(main), ["family", "label"], "left_anti")
    size = _small(saved(rest.groupBy("family").agg(blocks().alias("parts")), "rest"))
    rest = rest.join(size, "family").select("rep", "family", "label", F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int").alias("x"), each("blocks").alias("y"), F.lit(0).alias("side"))
    others = labelled.join(size, "family").select("rep", "family", "label", each("parts").alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"))
    return links.unionByName(_links(source, rest.unionByName(others), similarity))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Sets with 100 * intersection >= similarity * union are linked; component_id is the smallest
    doc_id reachable over links, kept whether it is the row's own. Texts without words (null,
    empty, blank) are linked with nothing. Rows that repeat an id count as one document each with
    that id. A row without an id is linked with nothing, has no component and is kept. An empty
    table gives none.
    """
    source = two(docs, id_col, text_col)
    profiles = saved(source.mapInArrow(_profile, "doc_id long, n_shingles long, same binary, bands array<long>"), "profiles")
    reps = saved(profiles.where("same is not null and doc_id is not null").groupBy("same").agg(F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("x"), F.min("doc_id").alias("rep")).select("same", "rep", "x.n_shingles", "x.bands"), "classes")
    rows = reps.select("rep", F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    stars = rows.join(centres, "key").where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    family = saved(connected(stars).join(reps.select("rep", "n_shingles"), F.col("node") == F.col("rep")).select("rep", F.col("root").alias("family"), "n_shingles"), "families")

    roots = connected(confirmed(source, family, similarity))
    out = profiles.join(reps.select("same", "rep"), "same", "left").join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stage: of each group of near copies (similarity 0.8 or more) the document of smallest id stays.

    Each row is a document of its own: of rows with one id some may go, and of equal ones one stays. Rows without an id stay.
    """
    names, key = docs.columns, "doc_id"
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        key = unused("row", names)  # numbers in the order of the ids, so that the smallest number has the smallest id
        ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
        docs = saved(ordered.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    gone = near_duplicates(docs, 80, id_col=key).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(_small(gone), key, "left_anti").select(*names)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s : s + least(len(w), 5) - 1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""
