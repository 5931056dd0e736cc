"""Putting old stores in order: narrators onto points of view, duplicate characters folded, hashes and repeats taken anew; shown as a plan, or done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import entities as E
from ..operators import folding, registry, resolve, validate
from ..session import saved
from ..sources.commits import Commits
from .save import CLAIMS, ENTITIES, ISSUES, TABLES, names

PLAN = ("story_id", "change", "id", "before", "after")


def _hash() -> Column:
    c = F.col
    by_id = T.entity_hash(c("subject_entity_id"), c("predicate"), c("object_entity_id"), c("claim_type"), c("polarity"))
    by_words = T.string_hash(c("subject"), F.coalesce(F.when(F.trim("claim_type") != "", c("claim_type")), "predicate"), c("object"), c("polarity"))
    return F.when(c("subject_entity_id") != 0, by_id).otherwise(by_words)


def _with_povs(entities: DataFrame, claims: DataFrame, scenes: DataFrame) -> DataFrame:
    """entities, and those of the points of view that a story with a narrator's entity lacks."""
    narrated = entities.where(E.is_placeholder(F.col("canonical_name"))).select("story_id").distinct()
    povs = scenes.join(narrated, "story_id", "left_semi").select("story_id", "pov")
    none = claims.select("story_id", F.lit(0).cast("long").alias("ord"), F.lit("").alias("name")).where("false")
    mine = saved(registry.registered(entities.join(narrated, "story_id", "left_semi"), registry.with_narrator(none, povs)).select(*names(ENTITIES), "place"), "backfill-povs")
    start = (entities.agg(F.max("id")).first()[0] or 0) + 1
    added = resolve.consecutive(mine.where("id is null").drop("id"), "id", start, "story_id", "place")
    return entities.join(narrated, "story_id", "left_anti").select(*names(ENTITIES)).unionByName(mine.where("id is not null").select(*names(ENTITIES))).unionByName(added.select(*names(ENTITIES)))


def _deduped(claims: DataFrame) -> DataFrame:
    """Of a scene's claims of one hash the best status stays, then the lowest id; a rejected one never gives way to another status."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in V.STATUS_RANK.items() for v in kv]), F.col("status")), F.lit(0))
    keys = ["scene_id", "source_hash"]
    w = Window.partitionBy(*keys).orderBy(rank.desc(), "id")
    x = claims.withColumns({"_r": F.row_number().over(w), "_best": F.first("status").over(w)})
    bare = F.coalesce("source_hash", F.lit("")) == ""
    return x.where(bare | (F.col("_r") == 1) | ((F.col("status") == "rejected") & (F.col("_best") != "rejected"))).drop("_r", "_best")


def _ordered(claims: DataFrame, entities: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """claims and entities as they should be."""
    columns = names(CLAIMS)
    known = saved(_with_povs(entities, claims, scenes), "backfill-entities")
    moved, left = folding.narrators_repointed(claims, known, scenes.select(F.col("id").alias("scene_id"), F.nullif(F.trim("pov"), F.lit("")).alias("pov")).where("pov is not null"))
    moved, left = saved(moved.select(*columns), "backfill-moved"), saved(left, "backfill-left")
    found = saved(folding.folds(left), "backfill-folds")
    before = claims.select("id", F.col("subject_entity_id").alias("_s"), F.col("object_entity_id").alias("_o"))
    x = folding.repointed(moved, left, found).join(before, "id")
    changed = ~F.col("_s").eqNullSafe(F.col("subject_entity_id")) | ~F.col("_o").eqNullSafe(F.col("object_entity_id"))
    x = saved(x.withColumn("source_hash", F.when(changed | (F.coalesce("source_hash", F.lit("")) == ""), _hash()).otherwise(F.col("source_hash"))).select(*columns), "backfill-hashed")
    return _deduped(x).select(*columns), folding.folded(left, found).select(*names(ENTITIES))


def backfill(tables: Commits, name: str, apply: bool = False) -> DataFrame:
    """The changes that old rows need: story_id, change, id, before, after; with `apply` they are also made, in one commit.

    change: fold or drop_entity (an entity goes), widen (it gains aliases or a place in the graph), add_entity, repoint (a claim's ends), rehash, restate (its
    status), drop_claim (a repeat). Both ways give the same plan, as applying reads the plan's own tables. Only stories in the plan are
    written and checked again, all of their scenes; the others keep their files. Hashes heed polarity, so a fact and its denial stay apart.
    """
    c = F.col
    expected = len(tables.entries())
    mine = {t: tables.read(t, schema) for t, (schema, _) in TABLES.items()}
    claims, entities = _ordered(mine["claims"], mine["entities"], mine["scenes"])
    claims, entities = saved(claims, "backfill-claims"), saved(entities, "backfill-entities")
    row = lambda df, change, before, after: df.select("story_id", F.lit(change).alias("change") if isinstance(change, str) else change.alias("change"), "id", before.cast("string").alias("before"), after.cast("string").alias("after"))

    a = mine["entities"].select("id", "story_id", "canonical_name", F.to_json(F.struct(F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("graph_eligible", F.lit(False)).alias("shown"))).alias("told"))
    b = entities.select("id", "story_id", "canonical_name", F.to_json(F.struct(F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("graph_eligible", F.lit(False)).alias("shown"))).alias("told"))
    gone, new = a.join(b, "id", "left_anti"), b.join(a, "id", "left_anti")
    both = a.join(b.select("id", c("told").alias("now")), "id").where("told <> now")
    changes = row(gone, F.when(E.is_placeholder(c("canonical_name")), "drop_entity").otherwise("fold"), c("canonical_name"), F.lit(None))
    changes = changes.unionByName(row(new, "add_entity", F.lit(None), c("canonical_name"))).unionByName(row(both, "widen", c("told"), c("now")))
    ends = lambda s, o: F.concat_ws(">", F.coalesce(c(s).cast("string"), F.lit("-")), F.coalesce(c(o).cast("string"), F.lit("-")))
    old = mine["claims"].select("id", "story_id", ends("subject_entity_id", "object_entity_id").alias("ends"), "status", "source_hash")
    now = claims.select("id", ends("subject_entity_id", "object_entity_id").alias("new_ends"), c("status").alias("new_status"), c("source_hash").alias("new_hash"))
    pair = saved(old.join(now.withColumn("kept", F.lit(True)), "id", "left"), "backfill-pairs")
    for change, was, becomes in (("repoint", "ends", "new_ends"), ("rehash", "source_hash", "new_hash"), ("restate", "status", "new_status")):
        changes = changes.unionByName(row(pair.where(c("kept") & ~c(was).eqNullSafe(c(becomes))), change, c(was), c(becomes)))
    changes = saved(changes.unionByName(row(pair.where("kept is null"), "drop_claim", c("source_hash"), F.lit(None))).select(*PLAN), "backfill-plan")
    if apply:
        stories = changes.select("story_id").distinct()
        touched = lambda df: df.join(stories, "story_id", "left_semi")
        scenes = touched(mine["scenes"]).select(c("id").alias("scene_id"))
        keys = scenes.unionByName(touched(mine["claims"]).select("scene_id")).distinct()
        prepared = validate.prepared(touched(claims), touched(mine["scenes"]), touched(entities))
        start = (mine["issues"].agg(F.max("id")).first()[0] or 0) + 1
        issues = resolve.consecutive(validate.issues(prepared), "id", start, "scene_id", "current_claim_id", "conflicting_claim_id", "conflict_kind").withColumn("resolution_status", F.lit("open"))
        tables.commit(
            name,
            {"claims": (touched(claims), keys, "scene_id"), "entities": (touched(entities), stories, "story_id"), "issues": (issues.select(*names(ISSUES)), keys.unionByName(touched(mine["issues"]).select("scene_id")), "scene_id")},
            expected=expected,
        )
    return changes
