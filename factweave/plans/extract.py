"""All layers of extraction over whole texts, where no model is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, chapters, evidence, extraction, kin
from ..operators.review import refined_predicate
from ..session import saved
from ..sources import providers
from ..sources.commits import Commits

_FIELDS = ("subject", "predicate", "target", "claim_type", "claim", "polarity", "confidence", "evidence", "canon_level", "generation_origin")


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of texts; `of` is what a rule takes for an id: the chunk with its point of view, so that claims need not be joined to it again."""
    c = F.col
    x = chapters.chunks(docs, "doc_id", "text", "pov").select(F.struct("doc_id", "chunk_index").alias("chunk"), "chunk_index", "pov", c("chunk").alias("text"))
    return x.withColumn("of", F.struct("chunk", "pov"))


def _layer(found: DataFrame, n: int, order: str) -> DataFrame:
    """One layer's claims, each with its place among all: chunk, layer, place in the layer."""
    x = found.withColumns({"chunk": F.col("doc_id.chunk"), "pov": F.col("doc_id.pov")})
    place = F.struct(F.col("chunk.chunk_index").alias("chunk_index"), F.lit(n).alias("layer"), F.col(order).cast("long").alias("n"))
    x = x.withColumn("ord", place).withColumn("id", F.struct("chunk", "ord"))
    return saved(x.select("id", F.col("chunk").alias("scene_id"), "ord", "pov", *[F.col(f).cast("double").alias(f) if f == "confidence" else f for f in _FIELDS]), f"layer{n}")


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pov_col: str = "pov") -> DataFrame:
    """(doc_id, chunk_index and the claim's fields) of each text: rules of stance, facts of kin, and the drafts of relations, or in a
    chunk without drafts the fallback rules.

    Within a chunk a stance that a draft tells too goes, and a draft of trust that a stance tells too is sure to 0.9 at least.
    Fragments go; then, over the whole text, stances of feeling that a draft tells and repeats go. Null and empty texts have none.
    Texts are read once for each layer, as Column expressions; each layer's claims are written to the shared folder as they are found,
    and all that compares layers reads those.
    """
    c = F.col
    d = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text"), c(pov_col).cast("string").alias("pov"))
    chunks = _chunks(d)
    rules = _layer(extraction.stances(chunks, "of", "text", "pov"), 0, "ord")
    family = _layer(kin.facts(chunks, "of", "text", "pov"), 1, "ord")
    drafted = candidates.drafts(candidates.relations(chunks, "of", "text", "pov")).withColumn("generation_origin", F.lit("llm"))
    drafted = _layer(drafted, 2, "start")
    bare = chunks.join(drafted.select(c("scene_id").alias("chunk")), "chunk", "left_anti")
    model = extraction.for_pov(drafted.unionByName(_layer(extraction.plain(bare, "of", "text"), 2, "ord")), c("pov"))

    told = extraction.redundant(model, rules).distinct().withColumn("told", F.lit(True))
    sure = F.when(c("told") & (extraction.family(c("predicate")) == "trust"), F.greatest("confidence", F.lit(0.9))).otherwise(c("confidence"))
    model = saved(model.join(told, "id", "left").withColumn("confidence", sure).drop("told"), "model")
    rules = rules.join(extraction.redundant(rules, model).distinct(), "id", "left_anti").select(*model.columns)

    return _kept(saved(_located_predicates(rules.unionByName(family).unionByName(model)), "layers")).select(c("scene_id").alias("doc_id"), "chunk_index", *_FIELDS)


def _located_predicates(claims: DataFrame) -> DataFrame:
    """Where someone lives, told by what the place is."""
    proof = F.coalesce(F.nullif("evidence", F.lit("")), "claim")
    return claims.withColumn("predicate", refined_predicate(F.col("predicate"), F.col("target"), proof))


def _kept(claims: DataFrame) -> DataFrame:
    """Without fragments, feelings that a draft tells too, and repeats over a whole text."""
    c = F.col
    every = extraction.judged(claims, c("pov")).where("reject_reason is null")
    junk = (c("predicate") == "loves") & F.lower(F.coalesce("target", F.lit(""))).isin("loved", "the vigorous", "the sun and")
    every = every.where(~junk).withColumns({"chunk_index": c("scene_id.chunk_index"), "scene_id": c("scene_id.doc_id")})
    return extraction.first_of_equal(extraction.without_redundant_structural(every))


def united(docs: DataFrame, provider=None, cache: Commits | None = None, strict: bool = False, id_col: str = "doc_id", text_col: str = "text", pov_col: str = "pov", **how) -> tuple[DataFrame, DataFrame]:
    """(claims, counts): all sources as one bag, each claim held against its chunk, told facts merged, as extraction with a recalling model does it.

    Sources are the rules of stance and of kin, the drafts of relations (origin fastus) and, with a provider, what it recalls of each
    chunk. Every claim gets its evidence in the chunk's words, and its confidence and status by that (`evidence.grounded`). Those
    of one chunk that tell the same are merged in the order rules, kin, drafts, recall; with `strict`, what was recalled and is
    found nowhere goes. Then, over the whole text, fragments and repeats go, as in extracted(). claims: doc_id, chunk_index, the fields,
    anchored, review_status, importance, n_sources. counts, a row a chunk: n_rules, n_drafts, n_recalled, n_merged, n_anchored,
    n_dropped. Null and empty texts have none. how: as for providers.answered().
    """
    c = F.col
    d = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text"), c(pov_col).cast("string").alias("pov"))
    chunks = saved(_chunks(d), "chunks")
    layers = [
        _layer(extraction.stances(chunks, "of", "text", "pov"), 0, "ord"),
        _layer(kin.facts(chunks, "of", "text", "pov"), 1, "ord"),
        _layer(candidates.drafts(candidates.relations(chunks, "of", "text", "pov")).withColumns({"generation_origin": F.lit("fastus"), "canon_level": F.lit("active")}), 2, "start"),
    ]
    bag = layers[0].unionByName(layers[1]).unionByName(layers[2]).withColumn("importance", F.lit("medium"))
    if provider is not None:
        recalled, _ = providers.recall(chunks, provider, cache, **how)
        importance = recalled.select(F.struct("chunk", F.struct(c("chunk.chunk_index").alias("chunk_index"), F.lit(3).alias("layer"), c("place").cast("long").alias("n")).alias("ord")).alias("id"), "importance")
        recalled = recalled.join(chunks.select("chunk", "of"), "chunk").withColumnRenamed("of", "doc_id")
        bag = saved(bag.unionByName(_layer(recalled.drop("chunk"), 3, "place").join(importance, "id")), "bag")
    claims = bag.withColumn("text_id", c("scene_id")).withColumn("review_status", F.lit(None).cast("string"))
    grounded = evidence.grounded(claims, chunks.select(c("chunk").alias("text_id"), "text")).drop("text_id")
    merged = extraction.merged_sources(grounded.withColumn("scene_id", F.struct("scene_id", "pov")))
    merged = merged.withColumns({"scene_id": c("scene_id.scene_id"), "pov": c("scene_id.pov")})
    merged = saved(_located_predicates(merged).withColumn("id", F.struct("scene_id", "ord")), "merged")
    kept = evidence.strict(merged) if strict else merged
    of = lambda df, *counts: df.groupBy(c("scene_id").alias("chunk")).agg(*counts)
    sources = of(bag, F.count_if(c("ord.layer") < 2).alias("n_rules"), F.count_if(c("ord.layer") == 2).alias("n_drafts"), F.count_if(c("ord.layer") == 3).alias("n_recalled"))
    dropped = F.count_if(~c("anchored") & (c("generation_origin") == "llm_recall")) if strict else F.lit(0).cast("long")
    after = of(merged, F.count("*").alias("n_merged"), F.count_if("anchored").alias("n_anchored"), dropped.alias("n_dropped"))
    counts = sources.join(after, "chunk").select("chunk.doc_id", "chunk.chunk_index", "n_rules", "n_drafts", "n_recalled", "n_merged", "n_anchored", "n_dropped")
    fields = [*_FIELDS, "anchored", "review_status", "importance", "n_sources"]
    return _kept(kept).select(c("scene_id").alias("doc_id"), "chunk_index", *fields), counts
