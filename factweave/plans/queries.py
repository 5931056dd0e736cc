"""Queries by name over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, chapters, editor, entities, evidence, extraction, folding, graph, kin, merge, registry, resolve, store, validate
from ..session import dealt, saved
from ..sources import manuscripts
from ..streaming import debounce, edits
from . import adapters as A
from . import answers, extract, readings, reviews, upgrades

Query = Callable[[SparkSession, str], DataFrame]


def _read(name: str) -> Query:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def _over(f: Callable[..., DataFrame], *tables: Query) -> Query:
    return lambda spark, d: f(*(t(spark, d) for t in tables))


def _graph(f: Callable[..., DataFrame], **how: bool) -> Query:
    return lambda s, d: f(A.claims(s, d), A.scenes(s, d), A.entities(s, d), **how)


def _prepared(spark: SparkSession, d: str, touched: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    return validate.prepared(A.claims(spark, d), A.scenes(spark, d), A.entities(spark, d), touched, more)


def _issues(kind: str | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return validate.issues(_prepared(spark, d), kinds=validate.KINDS if kind is None else (kind,))

    return run


def _severity(spark: SparkSession, d: str) -> DataFrame:
    return validate.conflicts(_prepared(spark, d)).groupBy("conflict_kind", "severity").agg(F.count("*").alias("n"))


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    c = A.claims(spark, d)
    x = F.col
    return c.select(
        "id",
        T.norm(x("claim_text")).alias("norm_text"),
        T.norm_evidence(x("evidence_text")).alias("norm_evidence"),
        T.predicate_key(x("predicate")).alias("predicate_key"),
        T.predicate_merge_key(x("predicate")).alias("merge_key"),
        T.infer_predicate(x("claim_type"), x("claim_text")).alias("inferred"),
        T.is_location(x("predicate")).alias("is_location"),
        T.place_granularity(x("object"), x("evidence_text"), F.lit(None).cast("string")).alias("granularity"),
        T.status_for_confidence(x("confidence")).alias("confidence_status"),
        T.predicate_group(x("predicate")).alias("predicate_group"),
    )


def _typed(spark: SparkSession, d: str) -> DataFrame:
    t = A.surfaces(spark, d).withColumn("t", entities.classify(F.col("name"), F.lit("It spoke."), F.col("role")))
    return t.select("name", "role", "t.*", entities.graph_eligible(F.col("t.entity_type"), F.col("t.type_confidence")).alias("graph_eligible"))


def _refined(spark: SparkSession, d: str) -> DataFrame:
    e = A.entities(spark, d).select("id", "entity_type")
    c = A.claims(spark, d).join(dealt(e.toDF("subject_entity_id", "s")), "subject_entity_id").join(dealt(e.toDF("object_entity_id", "o")), "object_entity_id")
    return c.select("id", entities.refined_type(F.col("claim_type"), F.col("predicate"), F.col("s"), F.col("o")).alias("claim_type"))


def _pov(spark: SparkSession, d: str) -> DataFrame:
    return extraction.for_pov(A.drafts(spark, d), F.col("pov")).select("id", "subject", "claim")


def _redundant(spark: SparkSession, d: str) -> DataFrame:
    x = A.drafts(spark, d)
    return extraction.redundant(x.where("generation_origin = 'llm'"), x.where("generation_origin = 'structural'"))


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    x = A.drafts(spark, d)
    told = evidence.weighed(F.col("confidence"), F.col("anchored"), F.col("evidence"), F.lit(None).cast("string"), F.lit("high"))
    return x.select("id", told.alias("w")).select("id", "w.*")


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    c = A.claims(spark, d).join(_claim_scenes(spark, d).toDF("scene_id", "text"), "scene_id")
    return c.select("id", evidence.anchored(F.col("text"), F.col("evidence_text"), F.when(F.col("id") % 2 == 0, F.col("claim_text"))).alias("anchored"))


def _claim_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that tell their claims, one sentence each."""
    c = A.claims(spark, d).groupBy("scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "claim_text"))), lambda x: F.concat(x["claim_text"], F.lit("."))), " ").alias("text"))
    return c.select(F.col("scene_id").alias("id"), "text")


def _split_claims(spark: SparkSession, d: str, new: bool) -> DataFrame:
    """Claims with a subject id: those of odd ids are stored, those of even ids newly extracted."""
    return A.claims(spark, d).where("subject_entity_id is not null").where(F.col("id") % 2 == (0 if new else 1)).withColumn("ord", F.col("id"))


def _resolved(spark: SparkSession, d: str, claims: DataFrame | None = None) -> DataFrame:
    """Claims told by their words alone, each an extracted one, onto the stored entities."""
    told = A.claims(spark, d) if claims is None else claims
    return resolve.resolved_claims(A.entities(spark, d), told.drop("subject_entity_id", "object_entity_id").withColumn("ord", F.col("id")))[0]


def _resolved_claims(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("id", "subject", "predicate", "object", "claim_type", "subject_entity_id", "object_entity_id", "source_hash", "unresolved")


def _stored_and_told(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims of odd ids as stored, those of even ids as newly extracted and resolved."""
    x = A.claims(spark, d).withColumns({"chunk_index": F.lit(0), "generation_origin": F.lit("structural"), "source": F.lit("extracted"), "claim_version": F.lit(1), "valid_from_scene": F.col("scene_id"), "confidence_history": F.lit(None).cast("string")})
    x = saved(x, "claims")  # read some six times by a merge, and each would deal the lines out anew
    return x.where("id % 2 = 1"), saved(_resolved(spark, d, x.where("id % 2 = 0")), "resolved").where("unresolved is null")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged(*_stored_and_told(spark, d))


def _whole_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged_rows(*_stored_and_told(spark, d))


def _canon(spark: SparkSession, d: str) -> DataFrame:
    s = merge.keyed(_split_claims(spark, d, False))
    return merge.with_canon(merge.keyed(_split_claims(spark, d, True)), s).select("id", "canon_id")


def _writing(spark: SparkSession, d: str) -> DataFrame:
    """Issues of writing at places given by the events: user_id stands for the text."""
    e = _read("events")(spark, d)
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("issue_id"), (F.col("event_id") * 37 % 5000).alias("start"), (F.col("event_id") % 60 + 1).alias("length"))


def _after_edit(spark: SparkSession, d: str) -> DataFrame:
    c = _read("customer")(spark, d).select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") * 11 % 5000).alias("at"), (F.col("c_custkey") % 9).alias("removed"), (F.col("c_custkey") % 7).alias("added"))
    return editor.after_edit(_writing(spark, d), c)


def _issue_at(spark: SparkSession, d: str) -> DataFrame:
    return editor.issue_at(_writing(spark, d), _writing(spark, d).select("doc_id", (F.col("start") + 5).alias("offset")).distinct())


def _folded(spark: SparkSession, d: str) -> DataFrame:
    e = A.cast(spark, d)
    return folding.folded(e, folding.folds(e)).select("id", "story_id", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "graph_eligible")


def _registered(spark: SparkSession, d: str) -> DataFrame:
    """The first stories' entities are stored; then the narrators of some, and all names in their order."""
    povs = A.stories(spark, d).select(F.col("id").alias("story_id"), F.when(F.col("id") % 3 == 0, "Isolde").alias("pov"))
    return registry.registered(A.entities(spark, d), registry.with_narrator(A.told_names(spark, d), povs))


def _repointed(spark: SparkSession, d: str) -> DataFrame:
    e = A.cast(spark, d)
    return folding.repointed(A.cast_claims(spark, d), e, folding.folds(e))


def _stamped(df: DataFrame) -> DataFrame:
    """The time of a save as text, the same in any session's zone."""
    return df.withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss.SSS"))


#: Milliseconds of a day.
DAY = 86_400_000

QUERIES: dict[str, Query] = {
    "adapter_scenes": A.scenes,
    "adapter_claims": A.claims,
    "val_issues_all": _issues(),
    "val_polarity_flip": _issues("polarity_flip"),
    "val_exclusive_object": _issues("exclusive_object"),
    "val_predicate_opposition": _issues("predicate_opposition"),
    "agg_issue_severity": _severity,
    # By given ids alone, as their SQL has it; the _named ones look up null ids too.
    "gra_edges": _graph(graph.edges, by_name=False),
    "gra_edges_preview": _graph(graph.edges, preview=True, by_name=False),
    "gra_nodes": _graph(graph.nodes, by_name=False),
    "gra_meta": _graph(graph.meta, by_name=False),
    "gra_edges_named": _graph(graph.edges),
    "gra_edges_preview_named": _graph(graph.edges, preview=True),
    "gra_nodes_named": _graph(graph.nodes),
    "gra_nodes_preview_named": _graph(graph.nodes, preview=True),
    "gra_supporting_named": lambda s, d: _graph(graph.supporting, preview=True)(s, d).select("story_id", "source", "target", "status", F.posexplode("supporting").alias("place", "x")).select("story_id", "source", "target", "status", "place", "x.*"),
    "gra_meta_named": _graph(graph.meta, preview=True),
    "joi_story_scene_count": _over(store.story_scene_counts, A.stories, A.scenes),
    "joi_scene_claim_count": _over(store.scene_claim_counts, A.scenes, A.claims),
    "agg_status_counts": _over(store.status_counts, A.claims),
    "flt_buckets": _over(store.bucket_counts, A.claims),
    "agg_next_scene": _over(store.next_scene, A.stories, A.scenes),
    "agg_synopsis": _over(store.synopsis, A.stories, A.scenes),
    "srt_new_claims": _over(store.new_claims_order, A.claims),
    "snk_markdown": _over(store.markdown, A.stories, A.scenes, A.claims),
    "hsh_source": _over(store.hashed, A.claims),
    "mrg_delete_replaceable": lambda s, d: store.without_replaceable(A.claims(s, d)).select("id", "status"),
    "mrg_transition": _over(store.transitions, A.claims),
    "mrg_stale_prune": _over(store.stale, A.claims, A.scenes),
    "win_scene_dedupe": _over(store.collapse_duplicates, A.claims),
    "str_scalars": _scalars,
    "str_word_count": lambda s, d: _read("documents")(s, d).select("doc_id", T.word_count(F.col("text")).alias("n_words")),
    "win_chunks": _over(chapters.chunks, _read("documents")),
    "txt_sentences": _over(chapters.sentences, _read("documents")),
    "src_html_text": lambda s, d: _read("pages")(s, d).select("page_id", manuscripts.html_text(F.col("html")).alias("text")),
    "src_scene_split": lambda s, d: manuscripts.scenes(_read("pages")(s, d), "page_id", manuscripts.html_text(F.col("html"))),
    "stm_latest_edit": _over(edits.latest, _read("events")),
    # Events stand for edits: of a user's page, its kind, in gaps of a day, as they lie hours apart.
    "stm_autosaves": lambda s, d: _stamped(debounce.saves(_read("events")(s, d), "event_type", key="user_id", gap=DAY)),
    "stm_checks": lambda s, d: _stamped(debounce.saves(_read("events")(s, d), "props", more=("event_type",), key="user_id", gap=DAY // 4, chars=debounce.CHECK_CHARS)),
    "stm_touched_issues": lambda s, d: validate.issues(_prepared(s, d, _read("events")(s, d).select(F.col("event_id").alias("scene_id")))),
    "ext_structural": lambda s, d: extraction.stances(A.claims(s, d), "id", "claim_text"),
    "ext_structural_documents": _over(extraction.stances, _read("documents")),
    "flt_reject_reason": lambda s, d: extraction.judged(A.drafts(s, d), F.col("pov")).select("id", "reject_reason"),
    "str_pov": _pov,
    "win_first_of_equal": lambda s, d: extraction.first_of_equal(A.drafts(s, d)).select("id", "scene_id"),
    "agg_merged_sources": lambda s, d: extraction.merged_sources(A.drafts(s, d)).drop("ord"),
    "joi_redundant_model": _redundant,
    "joi_redundant_structural": lambda s, d: extraction.without_redundant_structural(A.drafts(s, d)).select("id"),
    "cnd_names": _over(extraction.names, _read("documents")),
    "cnd_phrases": _over(candidates.phrases, A.tales),
    "cnd_relations": lambda s, d: candidates.relations(A.tales(s, d), pov_col="pov"),
    "cnd_drafts": lambda s, d: candidates.drafts(candidates.relations(A.tales(s, d), pov_col="pov")),
    "txt_tokens": _over(extraction.tokens, _read("documents")),
    "ent_types": _typed,
    "ent_refined_claim_type": _refined,
    "ent_resolved_names": _over(entities.resolved, A.mentions, A.entities),
    "ent_registered": _registered,
    "ent_resolved_claims": _resolved_claims,
    "ent_folds": lambda s, d: folding.folds(A.cast(s, d)),
    "ent_folded": _folded,
    "ent_repointed": _repointed,
    "ext_family": lambda s, d: kin.facts(A.letters(s, d), pov_col="pov"),
    "ext_all": lambda s, d: extract.extracted(A.tales(s, d)),
    "ext_united": lambda s, d: extract.united(A.tales(s, d))[0],
    "ext_united_counts": lambda s, d: extract.united(A.tales(s, d))[1],
    "ext_plain": lambda s, d: extraction.plain(A.claims(s, d), "id", "claim_text"),
    "evd_weighed": _weighed,
    "evd_anchored": _anchored,
    "evd_spans": lambda s, d: evidence.spans(A.claims(s, d), _claim_scenes(s, d)),
    "flt_strict": lambda s, d: evidence.strict(A.drafts(s, d)).select("id"),
    "mrg_ordered": _merged,
    "mrg_whole_rows": _whole_rows,
    "mrg_canon": _canon,
    "ui_after_edit": _after_edit,
    "ui_issue_at": _issue_at,
    "ui_segments": lambda s, d: editor.segments(_writing(s, d)),
    "ui_confidence_label": lambda s, d: A.claims(s, d).select("id", editor.confidence_label(F.col("confidence")).alias("label")),
    "ui_circle": lambda s, d: editor.circle(_graph(graph.nodes, by_name=False)(s, d)),
    "ui_circle_named": lambda s, d: editor.circle(_graph(graph.nodes)(s, d)),
    "ui_origins": lambda s, d: editor.origins_told(A.drafts(s, d)),
}

QUERIES |= reviews.queries(_prepared) | readings.QUERIES | answers.QUERIES | upgrades.QUERIES
