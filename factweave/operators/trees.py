"""Trees of dependencies: children and bounded subtrees of tokens that name their heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Steps from a subtree's root to its tokens, at most.
DEPTH = 8
#: Tokens of whole sentences that are walked at once, and listed tokens that are handed on at once.
TOKENS, LISTED = 1 << 14, 1 << 17


def _sentences(tokens: DataFrame, *fields: str) -> DataFrame:
    """A row per sentence: its tokens in order, one for each place, of the given fields alone."""
    return tokens.where("i is not null").groupBy("doc_id", "sentence_index").agg(F.sort_array(F.collect_list(F.struct("i", *fields))).alias("t"))


def _upwards(i: np.ndarray, heads: np.ndarray, first: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, place) for each token and each place from its own up to the root, at most `depth` steps; a head that isn't in the sentence, or was met
    before, ends the way. first, size: where a token's sentence begins, and how many tokens it has."""
    tokens, at = np.arange(len(i)), i
    ways, met = [(tokens, at)], [i]
    for _ in range(depth):
        inside = (at >= 0) & (at < size[tokens])
        tokens, at = tokens[inside], at[inside]
        up = heads[first[tokens] + at]
        on = (up >= 0) & (up < size[tokens])
        for before in met:
            on &= before[tokens] != up
        tokens, at = tokens[on], up[on]
        ways.append((tokens, at))
        met.append(np.full(len(i), -1))
        met[-1][tokens] = at
    return np.concatenate([t for t, _ in ways]), np.concatenate([p for _, p in ways])


def _listed(sentences: pa.RecordBatch, depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The subtrees of whole sentences: each token is listed under the places on its way, by one sort of numbers."""
    i, words, heads = sentences.column("t").flatten().flatten()
    i, heads = (x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (i, heads))
    if not len(i):
        return
    sizes = pc.list_value_length(sentences.column("t")).to_numpy(zero_copy_only=False)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    token, place = _upwards(i, heads, np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes), depth)
    low, width = int(place.min()), int(place.max()) - int(place.min()) + 1
    roots, root = sentence[token] * width + place - low, None
    if len(sizes) * width * len(i) >= 1 << 62:  # places with wide gaps
        root, roots = np.unique(roots, return_inverse=True)
    roots, token = np.divmod(np.sort(roots * len(i) + token), len(i))
    begin = np.flatnonzero(np.diff(roots, prepend=-1))
    end = np.append(begin[1:], len(roots))
    place = (roots[begin] if root is None else root[roots[begin]]) % width + low
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + LISTED, "right")))
        those = token[begin[a] : end[b - 1]]
        offsets = pa.array(np.append(begin[a:b], end[b - 1]) - begin[a], pa.int32())
        rows = pa.array(sentence[token[begin[a:b]]])
        indices = pa.ListArray.from_arrays(offsets, pa.array(i[those], pa.int32()))
        text = pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(those))), " "), characters=" ")
        columns = [sentences.column("doc_id").take(rows), sentences.column("sentence_index").take(rows), pa.array(place[a:b], pa.int32()), indices, text]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        a = b


def _below(depth: int):
    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys = [batch.schema.field(n) for n in ("doc_id", "sentence_index")]
            schema = pa.schema([*keys, ("root", pa.int32()), ("indices", pa.list_(pa.int32())), ("text", pa.string())])
            end = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(end):
                b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + TOKENS, "right")))
                yield from _listed(batch.slice(a, b - a), depth, schema)
                a = b

    return build


def subtrees(tokens: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, sentence_index, root, indices, text) for each token: the places under it, itself among them, rising, and their words.

    tokens: (doc_id, sentence_index, i, text, head, dep); i counts a sentence's from 0 without gaps, head is a place in the sentence, else the token is a root.
    Spark brings a sentence's tokens together; there each token walks up its heads, many sentences at once, and is listed under each it meets:
    no join, no level by level, no second grouping. Cycles end where they close. Nulls have no words.
    """
    x = _sentences(tokens.select("doc_id", "sentence_index", F.col("i").cast("int").alias("i"), F.coalesce("text", F.lit("")).alias("text"), F.col("head").cast("int").alias("head")), "text", "head")
    schema = StructType([tokens.schema["doc_id"], tokens.schema["sentence_index"]]).add("root", IntegerType()).add("indices", ArrayType(IntegerType())).add("text", StringType())
    return x.mapInArrow(_below(depth), schema)


def phrases(tokens: DataFrame, deps: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, sentence_index, root, indices) for each token: itself and its children, of the given labels if any are given, rising."""
    t = F.col("t")
    # Whether a token counts as a child is told before it is dealt out, so that no word or label is.
    told = tokens.withColumn("child", F.col("head").isNotNull() if deps is None else F.col("head").isNotNull() & F.coalesce(F.col("dep").isin(*deps), F.lit(False)))
    children = F.transform(t, lambda u: F.struct(u["head"].cast("int").alias("root"), F.when(u["child"], u["i"].cast("int")).alias("i")))
    own = F.transform(t, lambda u: F.struct(u["i"].cast("int").alias("root"), u["i"].cast("int").alias("i")))
    inside = F.filter(F.concat(own, children), lambda p: p["i"].isNotNull() & (p["root"] >= 0) & (p["root"] < F.size(t)))
    pairs = _sentences(told, "head", "child").select("doc_id", "sentence_index", F.explode(inside).alias("p"))
    return pairs.groupBy("doc_id", "sentence_index", "p.root").agg(F.sort_array(F.collect_set("p.i")).alias("indices"))
