"""Saving scenes as one job: texts, writers' claims, extraction, merge, pruning and continuity, committed together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import merge, resolve, review, store, validate
from ..session import saved
from ..sources.commits import Commits

SCENES = "id long, story_id long, scene_number int, text string, pov string"
CLAIMS = (
    "id long, story_id long, scene_id long, subject string, predicate string, object string, polarity boolean, subject_entity_id long, object_entity_id long, claim_type string, claim_text string, "
    "confidence double, canon_level string, status string, evidence_text string, chunk_index int, generation_origin string, source string, is_major_plotline boolean, source_hash string, "
    "claim_version int, valid_from_scene long, valid_until_scene long, confidence_history string"
)
ENTITIES = "id long, story_id long, canonical_name string, entity_type string, place_granularity string, type_confidence double, graph_eligible boolean, aliases array<string>"
ISSUES = (
    "id long, story_id long, scene_id long, current_claim_id long, conflicting_claim_id long, severity string, conflict_kind string, judge_classification string, judge_confidence double, message string, "
    "resolution_status string"
)
#: Schema and key of each table: what a commit replaces as a whole.
TABLES = {"scenes": (SCENES, "id"), "claims": (CLAIMS, "scene_id"), "entities": (ENTITIES, "story_id"), "issues": (ISSUES, "scene_id")}
MANUAL = "story_id long, scene_id long, ord long, subject string, predicate string, object string, polarity boolean, claim_type string, claim_text string, evidence_text string, confidence double, canon_level string, is_major_plotline boolean"

names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def _largest(df: DataFrame) -> int:
    return df.agg(F.max("id")).first()[0] or 0


def save(tables: Commits, name: str, scenes: DataFrame, manual: DataFrame | None, extract: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Saves scenes (id, story_id, scene_number, text, pov, run_extraction) and what their writers claim; returns counts, empty if `name` was saved before.

    Of each scene its issues go. Writers' claims (MANUAL), where a scene has any, replace its earlier ones. With run_extraction and
    a text that isn't blank, `extract` (scenes to rows of story_id, scene_id, ord, TAKEN and maybe review_status; ord orders a
    scene's) is run, tentative claims go, and its claims are merged into what is left. Claims whose evidence the text no longer has go, but for
    writers' and those just told, and with them the issues of the story that speak of them. Then the scenes are checked against
    all of their stories. Entities are told in the order scene, writers' claims, extracted ones.

    All is committed at once, for the touched scenes and stories only. Scenes of one job see the story as it was before it, not
    each other's new facts, as jobs that run at the same time do. If another job commits meanwhile, Taken is raised.
    """
    c = F.col
    expected = len(tables.entries())
    if any(e["name"] == name for e in tables.entries()):
        return {}
    spark = tables.spark
    scenes = saved(scenes.select(*names(SCENES), F.coalesce("run_extraction", F.lit(True)).alias("run")), "saves")
    ids, stories = scenes.select(c("id").alias("scene_id")), scenes.select("story_id").distinct()
    mine = {t: tables.read(t, schema) for t, (schema, _) in TABLES.items()}
    manual = spark.createDataFrame([], MANUAL) if manual is None else manual.select(*names(MANUAL))

    # What is told, by writers and by extraction, in the order of scenes.
    entered = review.manual_rows(manual.join(ids, "scene_id", "left_semi")).select(*names(MANUAL), F.lit(True).alias("entered"))
    live = scenes.where(c("run") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    found = extract(live).withColumn("entered", F.lit(False)).join(ids, "scene_id", "left_semi")
    if "review_status" not in found.columns:
        found = found.withColumn("review_status", F.lit(None).cast("string"))
    told = entered.unionByName(found, allowMissingColumns=True).withColumnRenamed("ord", "_own")
    told = told.withColumn("_turn", F.when(c("entered"), 0).otherwise(1))
    told = resolve.consecutive(told, "ord", 1, "story_id", "scene_id", "_turn", "_own")
    largest = _largest(mine["entities"])
    old_entities = mine["entities"].join(stories, "story_id", "left_semi")
    claims, entities = resolve.resolved_claims(old_entities, told, live.select("story_id", "pov"), largest + 1)
    claims = saved(claims, "claims-resolved")
    unresolved = claims.where("unresolved is not null")

    # Writers' rows.
    before = mine["claims"].join(ids, "scene_id", "left_semi")
    rewritten = manual.select("scene_id").distinct()
    stays = before.join(rewritten.withColumn("source", F.lit("manual")), ["scene_id", "source"], "left_anti")
    own = claims.where("entered and unresolved is null")
    text = F.coalesce(F.when(F.trim("claim_text") != "", c("claim_text")), F.trim(F.concat_ws(" ", "subject", "predicate", "object")))
    own = own.withColumns({"claim_text": text, "confidence": F.coalesce("confidence", F.lit(1.0)), "canon_level": F.coalesce("canon_level", F.lit("active")), "status": F.lit("approved"), "source": F.lit("manual"), "generation_origin": F.lit("manual"), "claim_version": F.lit(1), "id": F.lit(None).cast("long")})

    # The merge, of the scenes that are extracted; the others keep their rows.
    extracted = claims.where("not entered and unresolved is null").select("story_id", "scene_id", "ord", "review_status", "source_hash", *merge.TAKEN)
    running = live.select(c("id").alias("scene_id"))
    columns = names(CLAIMS)
    shaped = lambda df: df.select(*[(c(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in (x.split() for x in CLAIMS.split(", "))], *[n for n in ("ord", "action") if n in df.columns])
    fresh = shaped(own).withColumn("action", F.lit("entered"))
    # Accepted facts of the whole story, those just entered among them.
    canon = mine["claims"].join(stories, "story_id", "left_semi").join(rewritten.withColumn("source", F.lit("manual")), ["scene_id", "source"], "left_anti").select(*columns)
    numbered = resolve.consecutive(fresh, "_id", _largest(mine["claims"]) + 1, "ord").withColumn("id", c("_id")).drop("_id")
    numbered = saved(numbered, "claims-entered")
    canon = canon.unionByName(numbered.select(*columns))
    base = saved(stays.select(*columns).unionByName(numbered.select(*columns)), "claims-before")
    merged = saved(merge.merged_rows(base.join(running, "scene_id", "left_semi"), extracted, canon), "claims-merged")
    kept = shaped(merged.where("action <> 'suppressed' and id is not null")).unionByName(shaped(base.join(running, "scene_id", "left_anti")).withColumn("ord", F.lit(None).cast("long")).withColumn("action", F.lit("untouched")), allowMissingColumns=True)
    start = max(_largest(mine["claims"]), _largest(numbered)) + 1
    added = resolve.consecutive(shaped(merged.where("action = 'inserted'")).drop("id"), "id", start, "scene_id", "ord")
    after = saved(kept.unionByName(added, allowMissingColumns=True), "claims-after")

    # Pruning, and the issues of what goes.
    texts = scenes.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("id", "text")
    touched = after.where(c("action").isin("inserted", "reinforced")).select("id")
    all_issues = mine["issues"].join(stories, "story_id", "left_semi")
    others = all_issues.join(ids, "scene_id", "left_anti")
    claims_now, issues_left = review.pruned(after, others, store.stale(after, texts), touched)
    claims_now = saved(claims_now.select(*columns, "action"), "claims-now")
    changed = others.select("id", "scene_id").join(issues_left.select("id"), "id", "left_anti").select("scene_id").distinct()

    # Continuity of the saved scenes against their stories.
    story_scenes = mine["scenes"].join(stories, "story_id", "left_semi").join(ids.withColumnRenamed("scene_id", "id"), "id", "left_anti").select(*names(SCENES)).unionByName(scenes.select(*names(SCENES)))
    every = mine["claims"].join(stories, "story_id", "left_semi").join(ids, "scene_id", "left_anti").select(*columns).unionByName(claims_now.select(*columns))
    prepared = validate.prepared(every, story_scenes, entities, ids)
    raised = resolve.consecutive(validate.issues(prepared), "id", _largest(mine["issues"]) + 1, "scene_id", "current_claim_id", "conflicting_claim_id", "conflict_kind")
    raised = saved(raised.withColumn("resolution_status", F.lit("open")).select(*names(ISSUES)), "issues-raised")
    issues = raised.unionByName(issues_left.join(changed, "scene_id", "left_semi").select(*names(ISSUES)))

    # Counts come with the writing of the rows, not from jobs of their own.
    seen = Observation("save")
    counted = claims_now.observe(seen, *[F.count_if(c("action") == a).alias(a) for a in ("inserted", "reinforced", "entered", "closed")], F.count("*").alias("claims"))
    done = tables.commit(
        name,
        {
            "scenes": (scenes.select(*names(SCENES)), scenes.select("id"), "id"),
            "claims": (counted.select(*columns), ids, "scene_id"),
            "entities": (entities.select(*names(ENTITIES)), stories, "story_id"),
            "issues": (issues, ids.unionByName(changed), "scene_id"),
        },
        expected=expected,
    )
    if not done:
        return {}
    more = {"suppressed": merged.where("action = 'suppressed'").count(), "pruned": after.count() - seen.get["claims"], "unresolved": unresolved.count(), "issues": raised.count()}
    return {k: int(v) for k, v in (seen.get | more).items()}


def edit_claims(tables: Commits, name: str, edits: DataFrame) -> bool:
    """Edits of claims (id, and status, claim_text, subject, object, each null to leave it): the claim is resolved and hashed anew as a
    writer's, and the scenes of edited claims, and no others, are checked again."""
    c = F.col
    expected = len(tables.entries())
    mine = {t: tables.read(t, schema) for t, (schema, _) in TABLES.items()}
    change = edits.select(c("id"), *[c(x).alias(f"new_{x}") for x in ("status", "claim_text", "subject", "object")])
    hit = saved(mine["claims"].join(change, "id"), "claims-edited")
    ids, stories = hit.select("scene_id").distinct(), hit.select("story_id").distinct()
    new = {x: F.coalesce(F.trim(f"new_{x}"), c(x)) for x in ("claim_text", "subject", "object")} | {"status": F.coalesce("new_status", "status")}
    told = resolve.consecutive(hit.withColumns(new).drop(*[f"new_{x}" for x in new]), "ord", 1, "story_id", "id").withColumn("entered", F.lit(True))
    claims, entities = resolve.resolved_claims(mine["entities"].join(stories, "story_id", "left_semi"), told, None, _largest(mine["entities"]) + 1)
    columns = names(CLAIMS)
    edited = saved(claims.where("unresolved is null").select(*columns), "claims-edited")
    rest = mine["claims"].join(ids, "scene_id", "left_semi").join(edited.select("id"), "id", "left_anti").select(*columns)
    now = saved(rest.unionByName(edited), "claims-now")
    every = mine["claims"].join(stories, "story_id", "left_semi").join(ids, "scene_id", "left_anti").select(*columns).unionByName(now)
    prepared = validate.prepared(every, mine["scenes"], entities, ids)
    raised = resolve.consecutive(validate.issues(prepared), "id", _largest(mine["issues"]) + 1, "scene_id", "current_claim_id", "conflicting_claim_id", "conflict_kind")
    issues = raised.withColumn("resolution_status", F.lit("open")).select(*names(ISSUES))
    return tables.commit(name, {"claims": (now, ids, "scene_id"), "entities": (entities.select(*names(ENTITIES)), stories, "story_id"), "issues": (issues, ids, "scene_id")}, expected=expected)


def set_issue_states(tables: Commits, name: str, states: DataFrame) -> bool:
    """Sets issues (id) to a state (open, fixed, rejected); others, and unknown states, stay as they are."""
    mine = tables.read("issues", ISSUES)
    good = states.where(F.col("status").isin("open", "fixed", "rejected")).groupBy("id").agg(F.max("status").alias("new"))
    ids = mine.join(good, "id", "left_semi").select("scene_id").distinct()
    rows = mine.join(ids, "scene_id", "left_semi").join(good, "id", "left").withColumn("resolution_status", F.coalesce("new", "resolution_status")).select(*names(ISSUES))
    return tables.commit(name, {"issues": (rows, ids, "scene_id")}, expected=len(tables.entries()))


def remove_scenes(tables: Commits, name: str, removed: DataFrame) -> bool:
    """Removes scenes (scene_id) with their claims, and the issues of either."""
    mine = {t: tables.read(t, schema) for t, (schema, _) in TABLES.items()}
    ids = saved(mine["scenes"].select(F.col("id").alias("scene_id"), "story_id").join(removed.select("scene_id").distinct(), "scene_id", "left_semi"), "scenes-removed")
    stories = ids.select("story_id").distinct()
    ids = ids.select("scene_id")
    issues = mine["issues"].join(stories, "story_id", "left_semi")
    *_, left = review.without_scenes(ids, mine["scenes"], mine["claims"], issues)
    touched = issues.select("id", "scene_id").join(left.select("id"), "id", "left_anti").select("scene_id").distinct()
    none = lambda t: mine[t].where("false")
    return tables.commit(
        name,
        {"scenes": (none("scenes"), ids, "id"), "claims": (none("claims"), ids, "scene_id"), "issues": (left.join(touched, "scene_id", "left_semi").select(*names(ISSUES)), ids.unionByName(touched), "scene_id")},
        expected=len(tables.entries()),
    )


def taken_numbers(tables: Commits, scenes: DataFrame) -> DataFrame:
    """Scenes whose number another scene of their story has, among those to save or stored: they must not be saved."""
    stored = tables.read("scenes", SCENES).select("id", "story_id", "scene_number").join(scenes.select("id"), "id", "left_anti")
    every = stored.unionByName(scenes.select("id", "story_id", "scene_number"))
    twice = every.groupBy("story_id", "scene_number").agg(F.count("*").alias("n")).where("n > 1")
    return scenes.join(twice.drop("n"), ["story_id", "scene_number"], "left_semi")


def counts(tables: Commits) -> DataFrame:
    """Each story's claims by status now."""
    return store.status_counts(tables.read("claims", CLAIMS)).where(F.col("story_id").isNotNull())

