"""The character graph: accepted claims between characters as edges, characters as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import dealt, saved
from .entities import is_placeholder, resolved


def with_ends(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """claims whose null ids are looked up by name among their story's entities; no entity is made or changed.

    Names that no entity has, placeholders and blank ones stay null. Given ids stay.
    """
    ends = ("subject", "object")
    missing = [claims.where(F.col(f"{end}_entity_id").isNull()).select("story_id", F.col(end).alias("name")) for end in ends]
    found = resolved(missing[0].union(missing[1]).where(~is_placeholder(F.col("name"))), entities).where("entity_id is not null")
    found = saved(found.select("story_id", "name", "entity_id"), "graph-ends")  # once, as what follows reads the claims several times
    names = claims.columns
    for end in ends:
        claims = claims.join(dealt(found.select("story_id", F.col("name").alias(end), F.col("entity_id").alias("found_by_name"))), ["story_id", end], "left")
        claims = claims.withColumn(f"{end}_entity_id", F.coalesce(f"{end}_entity_id", "found_by_name")).drop("found_by_name")
    return claims.select(*names)


def _gated(claims: DataFrame, scenes: DataFrame, entities: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Asserted claims between two eligible characters, with their scene's number and graph predicate."""
    who = entities.where((F.col("entity_type") == "character") & F.col("graph_eligible")).select("id")
    c = claims.where(F.col("status").isin(*statuses) & F.coalesce("polarity", F.lit(True)) & (F.col("claim_type") == "relationship_state") & (F.col("subject_entity_id") != F.col("object_entity_id")))
    for end in ("subject_entity_id", "object_entity_id"):
        c = c.join(dealt(who.select(F.col("id").alias(end))), end, "left_semi")
    p = F.translate(F.lower(F.trim("predicate")), " ", "_")
    p = F.when(p.isin(*V.CLAIM_TYPES), F.translate(F.lower(T.infer_predicate(F.col("claim_type"), F.col("claim_text"))), " ", "_")).otherwise(p)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in V.CANON_WEIGHT.items() for v in kv]), F.lower(F.coalesce("canon_level", F.lit("active")))), F.lit(1.0))
    c = c.join(dealt(scenes.select(F.col("id").alias("scene_id"), "scene_number")), "scene_id")
    return c.select("id", "story_id", F.col("subject_entity_id").alias("source"), F.col("object_entity_id").alias("target"), p.alias("predicate"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), weight.alias("weight"), "scene_number")


def _pending(claims: DataFrame, scenes: DataFrame, entities: DataFrame, canon: DataFrame) -> DataFrame:
    """The first pending claim of each pair without accepted ones."""
    first = Window.partitionBy("source", "target").orderBy("id")
    pending = _gated(claims, scenes, entities, V.PREVIEW).join(dealt(canon.select("source", "target").distinct()), ["source", "target"], "left_anti")
    return pending.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def edges(claims: DataFrame, scenes: DataFrame, entities: DataFrame, preview: bool = False, by_name: bool = True) -> DataFrame:
    """A row per (source, target). With preview, pairs without accepted claims show their first pending one. by_name looks up null ids."""
    claims = with_ends(claims, entities) if by_name else claims
    canon = _gated(claims, scenes, entities, V.PAST_CANON).withColumn("status", F.lit("active"))
    if preview:
        canon = canon.unionByName(_pending(claims, scenes, entities, canon).withColumn("status", F.lit("preview")))
    rank = F.array_position(F.array(*[F.lit(g) for g in V.GROUPS]), T.predicate_group(F.col("predicate")))
    grouped = canon.groupBy("story_id", "source", "target", "status").agg(
        F.sort_array(F.collect_set("predicate")).alias("predicates"),
        F.min(rank).alias("rank"),
        F.count("*").alias("claim_count"),
        F.avg("confidence").alias("conf"),
        F.avg("weight").alias("weight"),
        F.sum("scene_number").alias("scene_sum"),
        F.max("scene_number").alias("scene_max"),
    )
    latest = grouped.groupBy("story_id").agg(F.max("scene_max").alias("max_scene"))
    primary = F.element_at(F.array(*[F.lit(g) for g in V.GROUPS]), F.col("rank").cast("int"))
    recency = F.when(F.col("max_scene") > 0, F.col("scene_sum") / (F.col("max_scene") * F.col("claim_count"))).otherwise(0.0)
    strength = F.col("claim_count") * 0.4 * F.col("weight") + F.col("conf") * 10 + recency * 0.3
    return grouped.join(dealt(latest), "story_id").select(
        "story_id",
        "source",
        "target",
        F.when(F.size("predicates") == 1, F.element_at("predicates", 1)).otherwise(primary).alias("label"),
        primary.alias("primary_relationship"),
        F.array_join("predicates", ",").alias("sub_relationships"),
        "claim_count",
        F.round("conf", 3).alias("confidence"),
        F.round(F.round(strength, 6), 2).alias("strength"),
        "status",
    )


def supporting(claims: DataFrame, scenes: DataFrame, entities: DataFrame, preview: bool = False, by_name: bool = True) -> DataFrame:
    """(story_id, source, target, status, supporting) for the pairs that edges() shows: their claims, by id, as structs of claim_id,
    predicate, claim_text (null where blank), confidence and scene_number."""
    claims = with_ends(claims, entities) if by_name else claims
    shown = _gated(claims, scenes, entities, V.PAST_CANON).withColumn("status", F.lit("active"))
    if preview:
        shown = shown.unionByName(_pending(claims, scenes, entities, shown).withColumn("status", F.lit("preview")))
    told = claims.select("id", F.nullif(F.trim("claim_text"), F.lit("")).alias("claim_text"))
    entry = F.struct(F.col("id").alias("claim_id"), "predicate", "claim_text", "confidence", "scene_number")
    return shown.join(dealt(told), "id").groupBy("story_id", "source", "target", "status").agg(F.sort_array(F.collect_list(entry)).alias("supporting"))


def nodes(claims: DataFrame, scenes: DataFrame, entities: DataFrame, by_name: bool = True, preview: bool = False) -> DataFrame:
    """Characters with mentions (negated claims count) or edges; degree counts claims, not distinct edges. by_name looks up null ids.

    With preview, the ends of pending edges are there too, though those count for neither mentions nor degree."""
    claims = with_ends(claims, entities) if by_name else claims
    ends = lambda df, a, b: df.select(F.explode(F.array(F.col(a), F.col(b))).alias("id")).where("id is not null and id <> 0")
    mentions = ends(claims.where(F.col("status").isin(*V.PAST_CANON)), "subject_entity_id", "object_entity_id").groupBy("id").agg(F.count("*").alias("mention_count"))
    canon = _gated(claims, scenes, entities, V.PAST_CANON)
    degree = ends(canon, "source", "target").groupBy("id").agg(F.count("*").alias("relationship_degree"))
    e = entities.where("entity_type = 'character'").join(dealt(mentions), "id", "left").join(dealt(degree), "id", "left").fillna(0, ["mention_count", "relationship_degree"])
    shown = (F.col("mention_count") > 0) | (F.col("relationship_degree") > 0)
    if preview:
        e = e.join(dealt(ends(_pending(claims, scenes, entities, canon), "source", "target").distinct().withColumn("pending", F.lit(True))), "id", "left")
        shown = shown | F.col("pending").isNotNull()
    e = e.where(shown)
    score = F.least(F.lit(100.0), F.round(F.col("mention_count") + F.col("relationship_degree") * 5.0, 1))
    return e.select("story_id", F.col("id").alias("entity_id"), F.col("canonical_name").alias("label"), score.alias("importance_score"), "mention_count", "relationship_degree")


def meta(claims: DataFrame, scenes: DataFrame, entities: DataFrame, preview: bool = False, by_name: bool = True) -> DataFrame:
    """Counts by story: accepted relationship claims and, with preview, the pending ones that edges() shows. by_name looks up null ids."""
    claims = with_ends(claims, entities) if by_name else claims
    canon = _gated(claims, scenes, entities, V.PAST_CANON)
    accepted = canon.groupBy("story_id").agg(F.count("*").alias("approved_relationship_claim_count"))
    if not preview:
        return accepted
    pending = _pending(claims, scenes, entities, canon).groupBy("story_id").agg(F.count("*").alias("pending_preview_claim_count"))
    return accepted.join(pending, "story_id", "full").fillna(0, ["approved_relationship_claim_count", "pending_preview_claim_count"])
